"""Embedding near-dedup by NN-descent.

Equal vectors become one node. Nodes get their first neighbours from sort orders by random projections; then, round by
round, the neighbours of each node meet, and each keeps the best it has met, for neighbours of neighbours are likely
neighbours. A list is enlarged while all that it holds is at or above the threshold. Edges at or above the threshold make the
components. A link between two nodes whose enlarged lists are full may be in neither list, so such nodes of different
components are compared exactly, but for those that the distance from another component's representative rules out.

An audit holds the components against brute force for a sample of nodes against all rows. The sample grows until it holds
enough nodes with few links, so that a large group doesn't speak for isolated pairs; a sample without links proves nothing,
unless it is the whole table. Where a link of the sample is missing, tables of any size get further rounds with more and more
orders, and are searched exactly if these don't reach it either, or if the sample can't tell, which no round would change.
So no result is returned that an audit has not passed or an exact search made. Then the members of a component are compared in blocks, which gives every vector's number of links in double precision, and
lists no pairs.

Defined cases: a vector that is null, empty, all zero, or holds a null or a component that isn't finite links with nothing,
is its own component and is kept; finite vectors of any size are compared; of vectors of different lengths, the shorter
counts as if it ended in zeros; repeated rows and ids are vectors of their own; a component is known by its least id; a null id comes last there and is never kept unless
alone; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm.common import in_shuffle, ship, staged, unstage
from tesserae.llm.graph import components

ship(__name__)

THRESHOLD = 0.9
#: Neighbours in a list, and in one whose entries all reach the threshold; orders by projections, next ones in an order.
LIST, ENLARGED, ORDERS, NEXT = 8, 24, 4, 4
#: Least and most rounds; nodes of the audit, and the recall that ends the rounds, for tables of any size.
FEWEST, MOST, AUDIT, RECALL = 2, 10, 256, 1.0
#: Most numbers of vectors that are held against all rows at once. A node of fewer links than SMALL has few.
HELD, SMALL = 1 << 20, 8
#: Rows and columns that are compared at once; what is added to single precision's error, and to angles.
TILE, MARGIN = 2048, 1e-3
BLOCK, BITS, SEED = 1024, 24, 11


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles, shorter ones ending in zeros, each by the power of two that brings its largest component
    below 1, so that no square is too large or too small; that changes no cosine."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(float)
    if len(ends) > 1 and (np.diff(ends) == width).all():
        out = values[ends[0] : ends[-1]].reshape(-1, width)
    else:
        out = np.zeros((len(column), width))
        for i, (a, b) in enumerate(zip(ends, ends[1:])):
            out[i, : b - a] = values[a:b]
    return np.ldexp(out, -np.frexp(np.abs(out).max(1, initial=0))[1][:, None])


def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row id, and two hashes of the vector, null for one that can't be compared."""
    rid = TaskContext.get().partitionId() << 40
    for batch in batches:
        column, h1, h2 = batch.column("_vec"), [], []
        for x in column:
            vec = np.array(x.as_py(), float) if x.is_valid and len(x) else np.zeros(1)
            good = np.isfinite(vec).all() and vec.any()
            a, b = divmod(xxhash.xxh3_128_intdigest(np.trim_zeros(vec + 0.0, "b").tobytes()), 1 << 64) if good else (None, None)
            h1.append(None if a is None else a - (a >> 63 << 64))
            h2.append(None if b is None else b - (b >> 63 << 64))
        ids = np.arange(rid, rid + batch.num_rows)
        rid += batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column("_key"), column, pa.array(ids), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], ["_key", "_vec", "rid", "h1", "h2"])


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x @ y.T) / np.sqrt((x * x).sum(1)[:, None] * (y * y).sum(1)[None, :])


def projected(width: int, orders: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).standard_normal((width, orders * BITS))
        for batch in batches:
            bits = (matrix(batch.column("vec"), width) @ planes > 0).reshape(-1, orders, BITS)
            keys = bits @ (1 << np.arange(BITS)[::-1])
            for r in range(orders):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, r, np.int32)), pa.array(keys[:, r]), batch.column("node"), batch.column("vec")], ["r", "key", "node", "vec"])

    return run


def edges(u: np.ndarray, v: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64)), pa.array(sim.astype(float))], ["u", "v", "sim"])


def next_ones(width: int):
    """Edges between each row and the next few of its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = batch.column("r").to_numpy(), batch.column("node").to_numpy(), matrix(batch.column("vec"), width)
            r, node, vec = now if held is None else tuple(np.concatenate(x) for x in zip(held, now))
            for step in range(1, NEXT + 1):
                i = np.flatnonzero((r[:-step] == r[step:]) & (node[:-step] != node[step:]))
                a, b = vec[i], vec[i + step]
                sim = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
                yield edges(np.concatenate([node[i], node[i + step]]), np.concatenate([node[i + step], node[i]]), np.concatenate([sim, sim]))
            held = r[-NEXT:], node[-NEXT:], vec[-NEXT:]

    return run


def met(width: int):
    """Those that meet at a node and are better than what either knows; rows come sorted by the node where they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def join(at: np.ndarray, node: np.ndarray, new: np.ndarray, least: np.ndarray, vec: np.ndarray) -> pa.RecordBatch:
            u, v, sims = [], [], []
            for i, j in zip(np.flatnonzero(np.r_[True, at[1:] != at[:-1]]), np.r_[np.flatnonzero(at[1:] != at[:-1]) + 1, len(at)]):
                if j - i > 1 and new[i:j].any():
                    sim = cosines(vec[i:j], vec[i:j])
                    good = (sim > least[i:j, None]) & (new[i:j, None] | new[None, i:j]) & (node[i:j, None] != node[None, i:j])
                    a, b = np.nonzero(good)
                    u.append(node[i + a])
                    v.append(node[i + b])
                    sims.append(sim[a, b])
            return edges(*(np.concatenate(x) if x else np.empty(0) for x in (u, v, sims)))

        held = None
        for batch in batches:
            now = *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "node", "new", "least")), matrix(batch.column("vec"), width)
            rows = now if held is None else tuple(np.concatenate(x) for x in zip(held, now))
            whole = int(np.flatnonzero(rows[0] != rows[0][-1])[-1]) + 1 if (rows[0] != rows[0][-1]).any() else 0
            if whole:
                yield join(*(x[:whole] for x in rows))
            held = tuple(x[whole:] for x in rows)
        if held is not None and len(held[0]):
            yield join(*held)

    return run


def best(found: DataFrame) -> DataFrame:
    """Of all that is known, each node's list. found: u, v, sim, new. least: what a newcomer must be above."""
    one = found.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    ranked = one.withColumn("rank", F.row_number().over(W.partitionBy("u").orderBy(F.desc("sim"), "v"))).where(F.col("rank") <= ENLARGED)
    kept = ranked.where((F.col("rank") <= LIST) | (F.col("sim") >= THRESHOLD))
    of_node = W.partitionBy("u")
    ends = kept.withColumns({"n": F.count("*").over(of_node), "low": F.min("sim").over(of_node), "full": F.sum(F.when(F.col("sim") >= THRESHOLD, 1).otherwise(0)).over(of_node)})
    least = F.when(F.col("n") < LIST, -2.0).when((F.col("full") == F.col("n")) & (F.col("n") < ENLARGED), F.lit(THRESHOLD)).otherwise(F.col("low"))
    return ends.select("u", "v", "sim", "new", least.alias("least"))


def ordered(nodes: DataFrame, width: int, orders: int, seed: int) -> DataFrame:
    """Edges between nodes that are near in one of so many orders."""
    kind = nodes.schema["vec"].dataType.simpleString()
    keyed = nodes.mapInArrow(projected(width, orders, seed), f"r int, key long, node long, vec {kind}")
    found = keyed.repartitionByRange("r", "key", "node").sortWithinPartitions("r", "key", "node").mapInArrow(next_ones(width), "u long, v long, sim double")
    return found.withColumn("new", F.lit(True))


def descended(lists: DataFrame, nodes: DataFrame, width: int, more: DataFrame | None = None) -> DataFrame:
    """One round: where a node is, its neighbours and the nearest of those that name it meet. more: further edges."""
    out = lists.select(F.col("u").alias("at"), F.col("v").alias("node"), "new")
    named = lists.withColumn("rank", F.row_number().over(W.partitionBy("v").orderBy(F.desc("sim"), "u"))).where(F.col("rank") <= LIST)
    both = out.union(named.select(F.col("v").alias("at"), F.col("u").alias("node"), "new")).groupBy("at", "node").agg(F.max("new").alias("new"))
    limits = lists.groupBy("u").agg(F.first("least").alias("least")).withColumnRenamed("u", "node")
    meeting = both.join(nodes.select("node", "vec").join(in_shuffle(limits), "node"), "node").select("at", "node", "new", "least", "vec")
    fresh = meeting.repartition("at").sortWithinPartitions("at", "node").mapInArrow(met(width), "u long, v long, sim double")
    old = lists.select("u", "v", "sim", F.lit(False).alias("new")).union(lists.select("v", "u", "sim", F.lit(True)))
    known = old.union(fresh.withColumn("new", F.lit(True)))
    return best(known.union(more) if more is not None else known)


def held_at_once(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """node, label and vec of all rows, on the driver."""
    got = rows.select("node", "label", "vec").toArrow()
    vec = got["vec"].combine_chunks() if len(got) else None
    return got["node"].to_numpy(), got["label"].to_numpy(), matrix(vec, width) if len(got) else np.zeros((0, width))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def tiles(n: int) -> Iterator[slice]:
    return (slice(i, i + TILE) for i in range(0, n, TILE))


def links_to(labels: np.ndarray, vecs: np.ndarray):
    """Pairs of components that a link joins, between the rows and what is held."""
    held = unit(vecs).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, x = batch.column("label").to_numpy(), matrix(batch.column("vec"), vecs.shape[1])
            own, found = unit(x).astype(np.float32), set()
            for r in tiles(len(x)):
                for c in tiles(len(held)):
                    i, j = np.nonzero(own[r] @ held[c].T >= THRESHOLD - MARGIN)
                    apart = label[r][i] != labels[c][j]
                    i, j = i[apart] + r.start, j[apart] + c.start
                    for k in tiles(len(i)):
                        a, b = x[i[k]], vecs[j[k]]
                        near = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1)) >= THRESHOLD
                        found.update(zip(label[i[k]][near].tolist(), labels[j[k]][near].tolist()))
            u, v = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def within_reach(labels: np.ndarray, vecs: np.ndarray, radius: np.ndarray):
    """Nodes that may have a link to another of the components whose representatives are held, by the triangle inequality."""
    held = unit(vecs)
    least = np.cos(np.minimum(np.arccos(THRESHOLD) + radius + MARGIN, np.pi))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, x = batch.column("label").to_numpy(), unit(matrix(batch.column("vec"), vecs.shape[1]))
            reach = np.zeros(len(x), bool)
            for r in tiles(len(x)):
                for c in tiles(len(held)):
                    reach[r] |= ((x[r] @ held[c].T >= least[c]) & (label[r][:, None] != labels[c])).any(1)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("node").to_numpy()[reach], pa.int64())], ["node"])

    return run


def parts(rows: DataFrame, width: int) -> tuple[DataFrame, int]:
    """The rows dealt into parts of which each can be held against all rows."""
    n = -(-rows.count() * width // HELD)
    return rows.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(max(n, 1)))), n


def joined_exactly(rows: DataFrame, width: int) -> DataFrame:
    """u, v: all pairs of components with a link between them. rows: node, label, vec, of the nodes to be compared.

    Every node meets every other one. Only pairs of components are written, and a part at a time reaches the driver.
    """
    dealt, n = parts(rows, width)
    found = rows.sparkSession.createDataFrame([], "u long, v long")
    for part in range(n):
        _, labels, vecs = held_at_once(dealt.where(F.col("part") == part), width)
        if len(vecs):
            met_now = dealt.where(F.col("part") >= part).mapInArrow(links_to(labels, vecs), "u long, v long")
            found = found.union(staged(met_now.distinct(), "joined"))
    return found


def of_full_lists(lists: DataFrame, labelled: DataFrame, width: int) -> DataFrame:
    """u, v: pairs of components with a link between nodes whose lists are full."""
    full = lists.where(F.col("sim") >= THRESHOLD).groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= ENLARGED)
    full = staged(labelled.join(full.select(F.col("u").alias("node")), "node"), "full")
    firsts = labelled.join(full.select("label").distinct().withColumnRenamed("label", "node"), "node").select("label", F.col("vec").alias("first"))

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = unit(matrix(batch.column("vec"), width)), unit(matrix(batch.column("first"), width))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(np.arccos(np.clip((a * b).sum(1), -1, 1)))], ["label", "angle"])

    radius = full.join(firsts, "label").select("label", "vec", "first").mapInArrow(angles, "label long, angle double").groupBy("label").agg(F.max("angle").alias("radius"))
    firsts = staged(firsts.join(radius, "label").select(F.col("label").alias("node"), "label", F.col("first").alias("vec"), "radius"), "firsts")
    dealt, n = parts(firsts, width)
    reached = None
    for part in range(n):
        here = dealt.where(F.col("part") == part).select("label", "vec", "radius").toArrow()
        if len(here):
            vecs = matrix(here["vec"].combine_chunks(), width)
            now = full.mapInArrow(within_reach(here["label"].to_numpy(), vecs, here["radius"].to_numpy()), "node long")
            reached = now if reached is None else reached.union(now)
    if reached is None:
        return joined_exactly(full, width)
    return joined_exactly(staged(full.join(reached.distinct(), "node"), "reached"), width)


class Audit:
    """Recall for a sample of nodes: the share of the links of each that lie in one component."""

    def __init__(self, nodes: DataFrame, width: int):
        self.width, self.n_nodes, self.size = width, nodes.count(), AUDIT
        self.sampled = nodes.select("node").orderBy(F.xxhash64("node"), "node")

    def shares(self, labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """How many links each node of the sample has, and the share of them that is found."""
        sample = labelled.join(F.broadcast(self.sampled.limit(self.size)), "node")
        asked, mine, vecs = held_at_once(sample, self.width)
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            true, found = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
            for batch in batches:
                node, label, x = batch.column("node").to_numpy(), batch.column("label").to_numpy(), matrix(batch.column("vec"), width)
                for r in tiles(len(x)):
                    for c in tiles(len(asked)):
                        near = (cosines(x[r], vecs[c]) >= THRESHOLD) & (node[r][:, None] != asked[c])
                        true[c] += near.sum(0)
                        found[c] += (near & (label[r][:, None] == mine[c])).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(asked))), pa.array(true), pa.array(found)], ["i", "true", "found"])

        got = labelled.mapInArrow(run, "i long, true long, found long").groupBy("i").agg(F.sum("true").alias("true"), F.sum("found").alias("found")).where(F.col("true") > 0).toArrow()
        true = got["true"].to_numpy()
        return true, got["found"].to_numpy() / np.maximum(true, 1)

    def passed(self, labelled: DataFrame) -> bool | None:
        """Whether recall is reached by nodes with few links, and by those with many; None if the sample can't tell."""
        while True:
            true, share = self.shares(labelled)
            few = true < SMALL
            if few.sum() >= AUDIT or self.size >= self.n_nodes or self.size * self.width >= HELD:
                break
            self.size = min(4 * self.size, max(HELD // self.width, AUDIT))
        if few.sum() < AUDIT and self.size < self.n_nodes:
            return None
        return all(share[c].mean() >= RECALL for c in (few, ~few) if c.any())


def link_counts(width: int):
    """Links of each member to the other block's vectors, copies counted; rows come sorted by component and blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def join(rows) -> pa.RecordBatch:
            _, block, node, copies, vec = rows
            near = cosines(vec, vec) >= THRESHOLD
            np.fill_diagonal(near, False)
            if block.min() != block.max():
                near &= block[:, None] != block
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array((near * copies).sum(1).astype(np.int64))], ["node", "links"])

        held: list[tuple] = []
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy() for c in ("label", "i", "j")], 1)
            rows = at, *(batch.column(c).to_numpy() for c in ("block", "node", "copies")), matrix(batch.column("vec"), width)
            cuts = np.r_[0, np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1, len(at)]
            for a, b in zip(cuts, cuts[1:]):
                if held and (held[-1][0][-1] != at[a]).any():
                    yield join(tuple(np.concatenate(x) for x in zip(*held)))
                    held = []
                held.append(tuple(x[a:b] for x in rows))
        if held:
            yield join(tuple(np.concatenate(x) for x in zip(*held)))

    return run


def near_dedup(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key, n_links, component_id and kept of every row."""
    frame = vectors.select(F.col(key).alias("_key"), F.col(vector).alias("_vec"))
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    rows = staged(frame.mapInArrow(described, f"_key {kinds['_key']}, _vec {kinds['_vec']}, rid long, h1 long, h2 long"), "vectors")
    known = rows.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("rid").alias("node"), F.count("*").alias("copies"))
    member = staged(rows.select("_key", "rid", "h1", "h2").join(known, ["h1", "h2"], "left").drop("h1", "h2"), "members")
    nodes = staged(rows.select("rid", F.col("_vec").alias("vec")).join(in_shuffle(member.where("rid = node").select("rid", "node", "copies")), "rid").drop("rid"), "nodes")
    width = nodes.agg(F.coalesce(F.max(F.size("vec")), F.lit(1))).first()[0]

    lists = staged(best(ordered(nodes, width, ORDERS, SEED)), "lists")
    audit, orders = Audit(nodes, width), ORDERS
    for done in range(MOST + 1):
        if done >= FEWEST:
            pairs = lists.where(F.col("sim") >= THRESHOLD).select("u", "v")

            def with_vectors(labels: DataFrame) -> DataFrame:
                return staged(nodes.select("node", "vec").join(in_shuffle(labels), "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")

            labels = components(pairs, "u", "v")
            labelled = with_vectors(labels)
            further = of_full_lists(lists, labelled, width)
            if further.limit(1).count():
                pairs = pairs.union(further)
                labels = components(pairs, "u", "v")
                labelled = with_vectors(labels)
            passed = audit.passed(labelled)
            if passed:
                break
            if done == MOST or passed is None:
                labels = components(pairs.union(joined_exactly(labelled, width)), "u", "v")
                break
            orders *= 2
        more = ordered(nodes, width, orders, SEED + done) if done >= FEWEST else None
        lists, old = staged(descended(lists, nodes, width, more), "lists"), lists
        unstage(old)

    inside = nodes.join(in_shuffle(labels), "node")
    blocks = labels.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    inside = inside.join(blocks, "label").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = inside.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "vec")
    dealt = dealt.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "node")
    counts = dealt.mapInArrow(link_counts(width), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    known = staged(labels.join(in_shuffle(counts), "node", "left"), "components")

    out = member.join(in_shuffle(known), "node", "left").withColumn("class", F.coalesce("label", "node"))
    least = out.where("class IS NOT NULL").groupBy(F.col("class").alias("c")).agg(F.min("_key").alias("least"))
    out = out.join(in_shuffle(least), out["class"] == least["c"], "left").withColumn("component_id", F.coalesce("least", "_key"))
    links = F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    kept = F.coalesce(F.col("_key") == F.col("component_id"), F.col("component_id").isNull())
    return out.select(F.col("_key").alias(key), links.cast("long").alias("n_links"), "component_id", kept.alias("kept"))
