"""An index of vectors in cells: a search reads the cells near its queries, and ranks what it reads by exact distances.

A coarse quantiser, k-means by MLlib, deals vectors to cells; they are written partitioned by cell, with each cell's number
of vectors and radius. A query asks the cells whose centres are nearest, so that the partitions of all others are pruned
before anything is read. How many cells that are is measured: as many as let audited queries find the wanted part of their
true neighbours. With exact=True a second pass reads all further cells which, by their radius, may hold a
vector that is nearer than the worst one found; the result is then that of a search through all vectors.

Centres reach every task; their number is bounded (CELLS). The quantiser is fitted to FIT vectors at most, a sample by the
hash of the key, but every vector is indexed. Large cells are written by several tasks.

Defined cases: vectors that are null or hold nulls or numbers that aren't finite are not indexed, for they have no distance;
vectors that are alike are ranked by key; an empty store gives an index that finds nothing; queries of another length are an
error. Other columns of the store stay beside the vector; one that is called cell is replaced.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, replace

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.operators import vector as V
from tesserae.staging import staged

#: Most cells; most vectors to which the quantiser is fitted, and its rounds; queries that are audited; recall that is wanted.
CELLS, FIT, ROUNDS, AUDIT, RECALL = 4096, 1 << 18, 10, 64, 0.95
#: What is added to a bound, relative to it, so that rounding loses no neighbour.
MARGIN = 1e-9


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    vector: str
    key: str
    #: Cells that a search reads for each query, and the recall that was measured with them.
    probes: int = 1
    recall: float | None = None

    @staticmethod
    def build(store: DataFrame, path: str, vector: str = "embedding", key: str = "vec_id", cells: int | None = None) -> VectorIndex:
        """Write an index of store to path, where nothing must be yet. cells: the square root of the vectors' number, if
        none is given."""
        spark, rows = store.sparkSession, store.where(V.is_comparable(F.col(vector)))
        n = rows.count()
        wanted = max(1, min(cells or round(math.sqrt(n)), CELLS, n))
        index = VectorIndex(spark, path, vector, key)
        if n:
            every = -(-n // FIT)
            sample = rows.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0)
            model = KMeans(k=wanted, maxIter=ROUNDS, seed=1, featuresCol="#v", predictionCol="cell").fit(sample.select(array_to_vector(vector).alias("#v")))
            model.save(f"{path}/model")
            centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
            spark.createDataFrame(centres, "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
            index.add(rows)
        else:
            rows.withColumn("cell", F.lit(0)).limit(0).write.parquet(f"{path}/vectors")
        index.save()
        return index

    @staticmethod
    def open(spark: SparkSession, path: str) -> VectorIndex:
        said = json.loads(spark.read.text(f"{path}/settings", wholetext=True).first()[0])
        return VectorIndex(spark, path, **said)

    def save(self) -> None:
        said = json.dumps({k: getattr(self, k) for k in ("vector", "key", "probes", "recall")})
        self.spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/settings")

    def add(self, store: DataFrame) -> None:
        """Index further vectors by the cells that there are. The same rows given twice stand there twice."""
        model = KMeansModel.load(f"{self.path}/model")
        rows = store.where(V.is_comparable(F.col(self.vector))).drop("cell").withColumn("#v", array_to_vector(self.vector))
        dealt = model.transform(rows).drop("#v")
        # Rebalanced by cell, small cells share a task and large ones are dealt to several.
        dealt.hint("rebalance", "cell").write.mode("append").partitionBy("cell").option("compression", "zstd").parquet(f"{self.path}/vectors")
        centres = self.spark.read.parquet(f"{self.path}/centres")
        far = model.transform(rows).join(F.broadcast(centres), "cell").select("cell", F.sqrt(V.squared_distance(F.col(self.vector), F.col("centre"))).alias("d"))
        far.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("radius")).coalesce(1).write.mode("append").parquet(f"{self.path}/radii")

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def cells(self) -> DataFrame:
        """cell, centre, n, radius of the cells that hold vectors."""
        parts = self.spark.read.parquet(f"{self.path}/radii").groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))
        return self.spark.read.parquet(f"{self.path}/centres").join(parts, "cell")

    def is_empty(self) -> bool:
        return self.vectors().isEmpty()

    def read(self, asked: DataFrame, k: int, limit: str | None = None) -> DataFrame:
        """query_id, key, score, rank of the k nearest among the cells that are asked. asked: query_id, query, cell. Cells
        that nobody asks are pruned from the scan; which are asked is a list of CELLS numbers at most. limit: a column of the
        largest score that is asked for."""
        cells = sorted(r.cell for r in asked.select("cell").distinct().collect())
        return V.top_k_each(self.vectors().where(F.col("cell").isin(cells)), asked, k, self.vector, self.key, among="cell", limit=limit)

    def search(self, queries: DataFrame, k: int = V.TOP_K, probes: int | None = None, exact: bool = False) -> DataFrame:
        """query_id, key, score, rank. queries: query_id, query; a stated set."""
        if self.is_empty():
            none = self.vectors().select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), self.key)
            return none.select("*", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank")).limit(0)
        cells = self.cells()
        near = V.top_k_each(cells, queries, CELLS if exact else probes or self.probes, "centre", "cell", carry=["radius"])
        near = staged(near.join(queries.select("query_id", "query"), "query_id"), "near-cells")
        first = near.where(F.col("rank") <= (probes or self.probes)).select("query_id", "query", "cell")
        found = self.read(first, k)
        if not exact:
            return found
        found = staged(found, "found")
        # The worst of k; where fewer were found, any vector may be among them.
        worst = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).alias("worst"))
        rest = near.where(F.col("rank") > (probes or self.probes)).join(worst, "query_id", "left")
        may = F.col("worst").isNull() | (F.sqrt("score") - F.col("radius") <= F.sqrt("worst") + MARGIN * (F.sqrt("worst") + F.sqrt("score")))
        further = self.read(staged(rest.where(may).select("query_id", "query", "cell", "worst"), "further-cells"), k, "worst")
        order = W.partitionBy("query_id").orderBy("score", self.key)
        both = found.drop("rank").unionByName(further.drop("rank"))
        return both.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)

    def tuned(self, queries: DataFrame, k: int = V.TOP_K, recall: float = RECALL) -> VectorIndex:
        """This index with the fewest probes that find the wanted part of the true neighbours of AUDIT of the queries (by the
        hash of their id). Saved with the index.

        A neighbour is found if its cell is read, and for each query cells are read in order. So one count of how far down
        the true neighbours' cells stand tells the recall of every number of probes.
        """
        if self.is_empty():
            return self
        some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(AUDIT)
        order = V.top_k_each(self.cells(), some, CELLS, "centre", "cell").select("query_id", "cell", F.col("rank").alias("place"))
        true = V.top_k_each(self.vectors(), some, k, self.vector, self.key, carry=["cell"]).select("query_id", "cell")
        places = true.join(order, ["query_id", "cell"]).groupBy("place").agg(F.count("*").alias("n")).orderBy("place").collect()
        total, found, probes = sum(r.n for r in places), 0, 1
        for r in places:
            found, probes = found + r.n, r.place
            if found >= recall * total:
                break
        index = replace(self, probes=probes, recall=found / total if total else None)
        index.save()
        return index
