"""Mixing sources to target weights.

Every document has a key by hash of its id and text, which is as good as random. Within each source documents stand in the order of their
keys; prefix sums of their token counts, in two levels (key ranges, then the rows of a range), tell which of them lie below
the source's budget. A budget over the source's size repeats whole epochs first; the last epoch is cut at the exact token.

Defined cases: a null text has size 0; a null source is a source of its own, the last; an empty table gives an empty
result; rows that are alike in key, id and size stand in any order, which changes no result; a source without tokens has
target 0; ties of keys are broken by the id, then by the size; ids may repeat or be null, as the text tells their rows apart;
a frame without the text's column is drawn by id alone, if the size is given; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm.common import staged

WEIGHTS, MAX_EPOCHS = (5, 2, 1), 3
#: Rows that a key range should hold.
RANGE_ROWS = 2_000


def n_words(text: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w"), r"[^w]+", "")).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target: shares by weight of the size of all, none above max_epochs times its own.

    sources: a row for each source. What a source can't take is shared anew until none is above its limit; the driver
    holds four numbers of each round.
    """
    ranked = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(ranked) - 1) % len(weights)
    weighed = staged(sources.withColumns({"w": F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")), "full": F.col("source_size") * max_epochs}), "sources")
    all_words = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, ended = 0.0, False
    while not ended:
        # A source is full if its share at this level would be above its limit; the level only rises.
        is_full = F.col("full") < level * F.col("w")
        got = weighed.agg(F.coalesce(F.sum(F.when(is_full, F.col("full"))), F.lit(0)), F.coalesce(F.sum(F.when(~is_full, F.col("w"))), F.lit(0))).first()
        new = (all_words - got[0]) / got[1] if got[1] else level
        ended, level = new <= level, max(level, new)
    share = F.lit(level) * F.col("w")
    return weighed.select("source", "source_size", F.when(F.col("full") < share, F.col("full").cast("double")).otherwise(share).alias("target"))


def draw_of(key: Column, text: Column | None, seed: str = "mix") -> Column:
    """The random key of a row: a hash of its key and text."""
    body = F.lit("") if text is None else F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), body).cast("binary"))


def mix(docs: DataFrame, size: Column | None = None, source: str = "source", key: str = "doc_id", text: str = "text", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix", with_draw: bool = False) -> DataFrame:
    """Every row's key, size, source_size, target and taken; taken: the tokens of it that the mix takes. with_draw: and source
    and draw, by which a row of a table can be told from others with its key."""
    size = n_words(F.col(text)) if size is None else size
    drawn = draw_of(F.col(key), F.col(text) if text in docs.columns else None, seed)
    rows = staged(docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), size.alias("size"), drawn.alias("draw")), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sources, weights, max_epochs)
    n = rows.count()
    digits = 1
    while n > RANGE_ROWS * 16**digits and digits < 8:
        digits += 1
    ranges = rows.groupBy("source", F.substring("draw", 1, digits).alias("_range")).agg(F.sum("size").alias("_sum"))
    before = W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    ranges = ranges.join(goals, ranges["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    within = W.partitionBy("source", "_range").orderBy("draw", "_key", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("_range", F.substring("draw", 1, digits)).withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.join(ranges, placed["source"].eqNullSafe(ranges["source"]) & (placed["_range"] == ranges["_range"]), "left")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.expr("CAST(floor(target) AS BIGINT) DIV source_size")).otherwise(F.lit(0).cast("long"))
    rest = budget - epochs * F.col("source_size") - F.col("_before") - F.col("_in")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest))
    named = [placed["source"].alias("source"), F.col("draw")] if with_draw else []
    return joined.select(*named, F.col("_key").alias(key), F.col("size"), "source_size", "target", (F.col("size") * epochs + part).cast("long").alias("taken"))
