"""Joins by time: the latest row before another, and the points within intervals. Both join by equal keys, never by pairs.

Defined cases: null keys and null times meet nothing; of rows with one time, the greatest by the further order is the latest;
an interval without a length, or that ends before it starts, holds nothing; empty tables meet nothing; rows of the left that
are alike are rows of their own; columns of both sides keep their names where these differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def micros(time: Column) -> Column:
    """A time as microseconds, whatever its zone."""
    return F.unix_micros(time.cast("timestamp"))


def as_of(left: DataFrame, right: DataFrame, key: tuple[str, str], time: tuple[str, str], carry: list[str], order: list[str] | None = None, stretch_s: int = 86400) -> DataFrame:
    """left with the columns to carry of the right row that is the latest, at the left row's time or before it; null where
    there is none.

    Both sides are put on one line and each left row takes the last right row before it. The line of a key is cut into
    stretches, which are worked on apart; what a stretch begins with is the last of those before it, of which there is one row
    for each stretch. So a key of a third of all rows is dealt to as many tasks as it has stretches.
    """
    best = F.struct(micros(F.col(time[1])).alias("t"), *(F.col(o).alias(f"o{i}") for i, o in enumerate(order or [])), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)))
    kinds = right.select(best.alias("b")).schema["b"].dataType
    ours = left.select(F.struct("*").alias("#row"), F.col(key[0]).alias("#k"), micros(F.col(time[0])).alias("#t"), F.lit(None).cast(kinds).alias("#b"), F.lit(1).alias("#side"))
    theirs = right.where(F.col(key[1]).isNotNull() & F.col(time[1]).isNotNull())
    theirs = theirs.select(F.lit(None).cast(left.select(F.struct("*").alias("r")).schema["r"].dataType).alias("#row"), F.col(key[1]).alias("#k"), micros(F.col(time[1])).alias("#t"), best.alias("#b"), F.lit(0).alias("#side"))
    stretch = F.floor(F.col("#t") / F.lit(stretch_s * 1_000_000))
    line = ours.union(theirs).withColumn("#stretch", stretch)
    within = W.partitionBy("#k", "#stretch").orderBy("#t", "#side", "#b").rowsBetween(W.unboundedPreceding, 0)
    placed = line.withColumn("#last", F.last("#b", ignorenulls=True).over(within)).where(F.col("#side") == 1)
    # The last right row of each stretch, and for every stretch of the left the last of those before it.
    ends = theirs.groupBy("#k", stretch.alias("#stretch")).agg(F.max("#b").alias("#b"))
    asked = placed.where("`#last` IS NULL AND `#k` IS NOT NULL AND `#t` IS NOT NULL").select("#k", "#stretch").distinct()
    steps = ends.select("#k", "#stretch", "#b").unionByName(asked.withColumn("#b", F.lit(None).cast(kinds)))
    steps = steps.groupBy("#k", "#stretch").agg(F.max("#b").alias("#b"))
    before = W.partitionBy("#k").orderBy("#stretch").rowsBetween(W.unboundedPreceding, -1)
    begins = steps.select("#k", "#stretch", F.last("#b", ignorenulls=True).over(before).alias("#before")).where("`#before` IS NOT NULL")
    out = placed.join(begins, ["#k", "#stretch"], "left").withColumn("#best", F.coalesce("#last", "#before"))
    return out.select("#row.*", *(F.col("#best")[f"c{i}"].alias(c) for i, c in enumerate(carry)))


#: Levels of interval lengths, of a power of two each, that share one size of cells.
BAND = 3


def in_intervals(points: DataFrame, intervals: DataFrame, key: tuple[str, str], at: str, start: str, end: str) -> DataFrame:
    """The pairs of a point and an interval of its key with start <= at < end, with the columns of both: point, interval.

    Each interval has a level, by its length, and levels are put into bands, from the longest interval down. A band's cells are
    at least as long as its intervals, which touch two cells at most, and not longer than 2 ** BAND times any of them. A point
    is in one cell of each band that there is; they join by key, band and cell. So no interval makes more than two rows,
    however long it is, a point makes a row for each band and not for each level, and no pair is made that lies further apart
    than two cells.
    """
    length = micros(F.col(end)) - micros(F.col(start))
    spans = intervals.where(F.col(key[1]).isNotNull() & (length > 0)).select(F.struct("*").alias("interval"), F.col(key[1]).alias("#k"), micros(F.col(start)).alias("#a"), micros(F.col(end)).alias("#b"))
    # Intervals of level n are shorter than 2 ** n microseconds.
    level = F.floor(F.log2(F.col("#b") - F.col("#a"))).cast("int") + 1
    known = sorted((r[0] for r in spans.select(level).distinct().collect()), reverse=True)
    bands: list[int] = []
    for n in known:
        if not bands or n <= bands[-1] - BAND:
            bands.append(n)
    # The cells of band n are 2 ** n microseconds long; an interval is in the least band that isn't below its level.
    band = F.coalesce(*(F.when(level <= n, F.lit(n)) for n in reversed(bands)), F.lit(None).cast("int"))
    cell = lambda t: F.floor(t / F.pow(F.lit(2.0), F.col("#band"))).cast("long")
    spans = spans.withColumn("#band", band)
    dealt = spans.withColumn("#cell", F.explode(F.array_distinct(F.array(cell(F.col("#a")), cell(F.col("#b") - 1))))).select("interval", "#k", "#band", "#cell")
    here = points.where(F.col(key[0]).isNotNull() & F.col(at).isNotNull()).select(F.struct("*").alias("point"), F.col(key[0]).alias("#k"), micros(F.col(at)).alias("#t"))
    here = here.withColumn("#band", F.explode(F.lit(bands).cast("array<int>"))).select("point", "#k", "#band", cell(F.col("#t")).alias("#cell"))
    t, a, b = micros(F.col("point")[at]), micros(F.col("interval")[start]), micros(F.col("interval")[end])
    return here.join(dealt, ["#k", "#band", "#cell"]).where((a <= t) & (t < b)).select("point", "interval")
