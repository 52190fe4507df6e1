"""Exact search for the nearest vectors, by squared distance in double precision; nearer is lower, ties go by id."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.staging import staged

# Workers get this module's functions by value, so that they need no path to this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOP_K = 20
#: Queries that are sent to all tasks at once, about, and their pairs with values that they ask among; distances in a tile.
AT_ONCE, PAIRS, TILE = 4096, 1 << 22, 1 << 20


def squared_distance(a: Column, b: Column) -> Column:
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gap, F.lit(0.0), lambda s, d: s + d * d)


def top_k(store: DataFrame, query: list[float], k: int = TOP_K, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """store's k nearest rows with score and rank: each task keeps its own k."""
    near = store.withColumn("score", squared_distance(F.col(vector), F.array(*(F.lit(float(x)) for x in query)))).orderBy("score", key).limit(k)
    return near.withColumn("rank", F.row_number().over(W.orderBy("score", key)).cast("long"))


def is_comparable(vector: Column) -> Column:
    """Neither null nor with an entry that is null or not finite."""
    bounded = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, bounded), F.lit(False))


def best(query: np.ndarray, score: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least (score, key) of each query."""
    order = np.lexsort((key, score, query))
    first = np.flatnonzero(np.r_[True, np.diff(query[order]) != 0]) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[rank < k]


def nearest(rows: DataFrame, vectors: np.ndarray, limits: np.ndarray, groups: dict | None, k: int) -> DataFrame:
    """#q (a query's place in vectors), rows' columns but #v and #among, and score: of each task the k nearest of every query.
    rows: #v, #key, others. limits: the largest score that a query asks for. groups: the places of the queries that ask a
    value of #among.

    Distances are summed dimension by dimension, so that they are the same numbers wherever they are made; what a task holds
    is a tile of them and the nearest so far.
    """
    n, width = vectors.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0

        def merged() -> list[tuple[np.ndarray, np.ndarray, pa.Table]]:
            query, score = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            table = pa.concat_tables([f[2] for f in found])
            keep = best(query, score, ordered(table["#key"]), k)
            return [(query[keep], score[keep], table.take(pa.array(keep)))]

        def ordered(column: pa.ChunkedArray) -> np.ndarray:
            out = column.to_numpy()
            return out.astype(str) if out.dtype == object else out

        for batch in batches:
            table = pa.Table.from_batches([batch])
            x = table["#v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            rest = table.drop_columns([c for c in ("#v", "#among") if c in table.column_names])
            if groups is None:
                asked = [(np.arange(len(x)), np.arange(n))]
            else:
                values = np.array(table["#among"].to_pylist(), dtype=object)
                asked = [(np.flatnonzero(values == v), groups[v]) for v in dict.fromkeys(values.tolist()) if v in groups]
            for mine, queries in asked:
                step = max(1, TILE // max(1, len(queries)))
                for at in range(0, len(mine), step):
                    some = mine[at : at + step]
                    score = np.zeros((len(queries), len(some)))
                    for j in range(width):
                        gap = vectors[queries, j][:, None] - x[some, j][None]
                        score += gap * gap
                    # Only what may be among a query's k nearest is ordered by key too.
                    worst = np.partition(score, k - 1, axis=1)[:, k - 1 : k] if len(some) > k else np.inf
                    q, r = np.nonzero(score <= np.minimum(worst, limits[queries][:, None]))
                    keep = best(q, score[q, r], ordered(rest["#key"])[some[r]], k)
                    q, r = q[keep], r[keep]
                    found.append((queries[q], score[q, r], rest.take(pa.array(some[r]))))
                    held += len(q)
                    if held > TILE:
                        found = merged()
                        held = len(found[0][0])
        if found:
            [(query, score, table)] = merged()
            yield from table.append_column("score", pa.array(score)).add_column(0, "#q", pa.array(query, pa.int64())).to_batches()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in ("#v", "#among"))
    return rows.mapInArrow(run, f"`#q` long, {kinds}, score double")


def top_k_each(store: DataFrame, queries: DataFrame, k: int = TOP_K, vector: str = "embedding", key: str = "vec_id", among: str | None = None, carry: list[str] | None = None, limit: str | None = None) -> DataFrame:
    """query_id, key, the store's columns to carry, score, rank of every query's k nearest. queries: query_id, query; a stated
    set, held against all rows; with among, a column that both frames have, against the rows that have the query's value of
    it, and a query may stand there several times with different ones; with limit, a column of the queries, rows of a larger
    score are left out, where it isn't null.

    So many queries at a time are sent to all tasks, of which each keeps its own k for every query; more queries take more
    passes over the store, and what each finds is written. Vectors without a distance to the queries (null, with nulls or
    numbers that aren't finite, or of another length) aren't found, and such queries find nothing.
    """
    carry, spark = carry or [], store.sparkSession
    asked = queries.where(is_comparable(F.col("query"))).select("query_id", F.col("query").cast("array<double>").alias("query"), (F.col(limit) if limit else F.lit(None)).cast("double").alias("#limit"), *([F.col(among).alias("#asked")] if among else []))
    sizes = asked.agg(F.count_distinct("query_id").alias("n"), F.count("*").alias("pairs"), F.min(F.size("query")).alias("least"), F.max(F.size("query")).alias("most")).first()
    if sizes.least != sizes.most:
        raise ValueError(f"queries have {sizes.least} to {sizes.most} dimensions")
    rows = store.where(is_comparable(F.col(vector)) & (F.size(vector) == F.lit(sizes.most or 0)))
    rows = rows.select(F.col(key).alias("#key"), *(F.col(c).alias(f"#c{i}") for i, c in enumerate(carry)), F.col(vector).alias("#v"), *([F.col(among).alias("#among")] if among else []))
    names = [F.col("#key").alias(key), *(F.col(f"#c{i}").alias(c) for i, c in enumerate(carry))]
    kind = queries.schema["query_id"].dataType.simpleString()
    parts = max(-(-sizes.n // AT_ONCE), -(-sizes.pairs // PAIRS), 1)
    dealt = asked.withColumn("#part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    found = None
    for part in range(parts):
        here = dealt.where(F.col("#part") == part)
        once = here.groupBy("query_id").agg(F.min("query").alias("query"), F.max("#limit").alias("limit")).toArrow()
        vectors = np.array(once["query"].to_pylist(), float).reshape(len(once), sizes.most or 1)
        limits = np.array([np.inf if x is None else x for x in once["limit"].to_pylist()], float)
        groups = None
        if among:
            place, groups = {q: i for i, q in enumerate(once["query_id"].to_pylist())}, {}
            for q, value in zip(*(c.to_pylist() for c in here.select("query_id", "#asked").distinct().toArrow().columns)):
                groups.setdefault(value, []).append(place[q])
            groups = {v: np.array(sorted(p)) for v, p in groups.items()}
        ids = spark.createDataFrame([(i, q) for i, q in enumerate(once["query_id"].to_pylist())], f"`#q` long, query_id {kind}")
        near = nearest(rows if len(once) else rows.limit(0), vectors, limits, groups, k)
        ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("#q").orderBy("score", "#key")).cast("long")).where(F.col("rank") <= k)
        told = ranked.join(F.broadcast(ids), "#q").select("query_id", *names, "score", "rank")
        told = staged(told, "nearest") if parts > 1 else told
        found = told if found is None else found.union(told)
    return found


def search_components(store: DataFrame, queries: DataFrame, facets: dict[str, str], k: int = TOP_K, key: str = "vec_id", among: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """facet, key, the columns to carry, score, rank: the queries of all components in one job. queries: component, text,
    query; one without text asks nothing. facets: the facet that a component is searched for. among: the store's column that
    names a row's component, where a component's query asks for its own rows only."""
    named = F.create_map(*(F.lit(x) for pair in facets.items() for x in pair))
    asked = queries.where("text <> ''").select(F.col("component").alias("query_id"), "query", *([F.col("component").alias(among)] if among else []))
    near = top_k_each(store, asked, k, key=key, among=among, carry=carry)
    return near.select(F.try_element_at(named, F.col("query_id")).alias("facet"), key, *(carry or []), "score", "rank")


def previewed(hits: DataFrame, content: str, rows: int = 5, length: int = 100) -> DataFrame:
    """The first hits of each facet, by rank, with the beginning of their content: what a log shows."""
    return hits.where(F.col("rank") <= rows).withColumn(content, F.substring(content, 1, length))
