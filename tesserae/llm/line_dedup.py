"""Line dedup by the frequency of lines within a site.

For each host and line, the pages of the host that hold the line are divided by all pages of the host; lines whose share is
above the limit are boilerplate, and are dropped from every page of that host. Lines are compared without the white space at
their ends, and by 128 bits of hash, so that no line's text is shuffled.

A line on a single page of its host repeats nothing, so it isn't boilerplate however few pages the host has (min_hits); a
floor for the pages of a host (min_pages) is there for those who want one, and is none by default.

Defined cases: a null text stays null and has no lines; lines without a word are neither counted nor dropped; a null host is
a host of its own; rows are pages, repeated rows and ids are pages of their own; a page that loses all its lines keeps an
empty text; every other text is its lines that stay, put together again, whether one was dropped or none; an empty table
gives an empty result; further columns stay as they are, whatever their names, but n_lines and n_dropped are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import SPACE, staged

#: A line on more than so many percent of a host's pages is boilerplate, and on so many of them at least.
PERCENT, MIN_HITS = 30, 2


def mark(line: Column) -> Column:
    """What a line is known by; null for a line without words."""
    core = F.regexp_replace(line, f"^{SPACE}+|{SPACE}+$", "")
    return F.when(core != "", F.struct(F.xxhash64(core).alias("a"), F.xxhash64(F.lit("line"), core).alias("b")))


def boilerplate(pages: DataFrame, percent: int = PERCENT, min_hits: int = MIN_HITS, min_pages: int = 1) -> DataFrame:
    """host, marks: the marks of each host's lines above the limit, fewer than lines per page over the share for a host.
    pages: host, lines."""
    totals = pages.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    own = F.array_distinct(F.filter(F.transform("lines", mark), lambda x: x.isNotNull()))
    counted = pages.select("host", F.explode(own).alias("m")).groupBy("host", "m").agg(F.count("*").alias("n")).where(F.col("n") >= min_hits)
    common = counted.join(totals, counted["host"].eqNullSafe(totals["host"])).drop(totals["host"]).where(100 * F.col("n") > percent * F.col("pages"))
    return common.groupBy("host").agg(F.sort_array(F.collect_list("m")).alias("marks"))


def line_dedup(pages: DataFrame, host: Column, text: str = "text", break_at: str = "\n", glue: str = "\n", percent: int = PERCENT, min_hits: int = MIN_HITS, min_pages: int = 1) -> DataFrame:
    """pages with the boilerplate lines out of text, and n_lines, n_dropped.

    break_at: the pattern at which a text is cut into lines; glue: what they are put together with again.
    """
    # The row goes along in one column, so that no name of its own can clash.
    packed = pages.select(F.struct("*").alias("row"), host.alias("host"), F.split(F.col(text), break_at).alias("lines"))
    known = staged(boilerplate(packed.select("host", "lines"), percent, min_hits, min_pages), "boilerplate").withColumnRenamed("host", "of")
    # The table of boilerplate is written, so its true size decides: a small one is broadcast, for a large one both sides
    # are dealt by host, and hosts with very many pages are split at run time.
    met = packed.join(known, packed["host"].eqNullSafe(known["of"]), "left")
    left = F.filter("lines", lambda x: ~F.coalesce(F.array_contains("marks", mark(x)), F.lit(False)))
    met = met.withColumn("left", F.when(F.col("marks").isNull(), F.col("lines")).otherwise(left))
    n, n_left = (F.coalesce(F.size(c), F.lit(0)).cast("long") for c in ("lines", "left"))
    body = F.when(F.col("lines").isNotNull(), F.array_join("left", glue))
    made = [body.alias(c) if c == text else F.col("row")[c].alias(c) for c in pages.columns if c not in ("n_lines", "n_dropped")]
    return met.select(*made, n.alias("n_lines"), (n - n_left).alias("n_dropped"))
