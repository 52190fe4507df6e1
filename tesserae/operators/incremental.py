"""A profile that is kept up to date: batches of records are added to stored counts, and no record is read twice.

A batch's counts are written as a partition of their own, named by the batch's id, in place of what stood there: a batch that
is applied again, by a retry or a stream that goes on from its checkpoint, changes nothing. Reading sums the batches. So
that reading stays cheap, batches are folded into a base now and then: a new generation is written beside the old one, and
counts only once the list of the batches in it is written too, so that readers never see half of it.

Defined cases: a batch id stands for one batch, and one that a base holds already is left as it is; batches of records that
were taken back count negatively, and values that nothing counts any more have no row; an empty batch adds nothing; a profile
without batches is empty. One writer at a time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesserae.operators import profile
from tesserae.schema import FacetSchema
from tesserae.staging import delete

COUNTS = "entity string, facet string, value string, n long"


@dataclass(frozen=True)
class ProfileStore:
    spark: SparkSession
    path: str
    schema: FacetSchema

    def table(self, name: str, ddl: str) -> DataFrame:
        """What is stored under a name; nothing if nothing was yet."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        where = jvm.Path(f"{self.path}/{name}")
        there = where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(where)
        return self.spark.read.schema(ddl).parquet(str(where)) if there else self.spark.createDataFrame([], ddl)

    def generation(self) -> int:
        """The newest base that is whole; 0 before the first."""
        return self.table("ledger", "batch string, generation int").agg(F.max("generation")).first()[0] or 0

    def folded(self, generation: int) -> DataFrame:
        """The batches that a base holds."""
        return self.table("ledger", "batch string, generation int").where(F.col("generation") == generation).select("batch")

    def apply(self, records: DataFrame, batch: str, taken_back: bool = False) -> None:
        """Add the counts of a batch of records, or take them off."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"a batch's id has letters, digits, '_', '.' and '-', not {batch!r}")
        if not self.folded(self.generation()).where(F.col("batch") == batch).isEmpty():
            return
        counts = profile.entity_profile(records, self.schema).withColumn("n", F.col("n") * (-1 if taken_back else 1))
        out = counts.select("entity", "facet", "value", "n", F.lit(batch).alias("batch"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/deltas")

    def read(self) -> DataFrame:
        """entity, facet, value, n."""
        generation = self.generation()
        fresh = self.table("deltas", f"{COUNTS}, batch string").join(F.broadcast(self.folded(generation)), "batch", "left_anti").drop("batch")
        base = self.table("bases", f"{COUNTS}, generation int").where(F.col("generation") == generation).drop("generation")
        return base.unionByName(fresh).groupBy("entity", "facet", "value").agg(F.sum("n").alias("n")).where("n <> 0")

    def fold(self) -> None:
        """Make a new base of the old one and all batches, and drop what it replaces."""
        old = self.generation()
        known = self.folded(old).collect()
        new = sorted({r.batch for r in self.table("deltas", f"{COUNTS}, batch string").select("batch").distinct().collect()} - {r.batch for r in known})
        if not new:
            return
        overwrite = lambda df, name: df.withColumn("generation", F.lit(old + 1)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("generation").parquet(f"{self.path}/{name}")
        overwrite(self.read(), "bases")
        overwrite(self.spark.createDataFrame([(b,) for b in [*(r.batch for r in known), *new]], "batch string"), "ledger")
        for batch in new:
            delete(self.spark, f"{self.path}/deltas/batch={batch}")
        delete(self.spark, f"{self.path}/bases/generation={old}")
        delete(self.spark, f"{self.path}/ledger/generation={old}")

    def follow(self, stream: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
        """Apply a stream's batches as they come, each by its number under a name; a batch that comes again counts once."""
        apply = lambda records, number: self.apply(records, f"{name}-{number}")
        return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
