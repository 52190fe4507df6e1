"""Consecutive numbers for the rows of a table, without a task that sees all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.staging import staged


def numbered(frame: DataFrame, order: list[Column | str], to: str) -> DataFrame:
    """frame with its rows' places, from 0, in an order; rows that it doesn't tell apart are in some order of their own.

    Rows are dealt by ranges of the order and sorted there, and written once; where a range begins follows from the numbers
    of rows of the ranges before it, which are all that the driver gets.
    """
    dealt = frame.select(F.struct("*").alias("#row"), *(F.col(o).alias(f"#o{i}") if isinstance(o, str) else o.alias(f"#o{i}") for i, o in enumerate(order)))
    keys = [f"#o{i}" for i in range(len(order))]
    ranged = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).select("#row", F.monotonically_increasing_id().alias("#id"))
    rows = staged(ranged, "numbered")
    part, place = F.shiftright("#id", 33), F.col("#id").bitwiseAND(F.lit((1 << 33) - 1))
    starts, at = [], 0
    for r in rows.groupBy(part.cast("int").alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        starts.append((r.part, at))
        at += r.n
    spark = frame.sparkSession
    begins = F.broadcast(spark.createDataFrame(starts, "`#part` int, `#start` long"))
    met = rows.withColumn("#part", part.cast("int")).join(begins, "#part")
    return met.select("#row", (F.col("#start") + place).alias("#n")).select("#row.*", F.col("#n").alias(to))
