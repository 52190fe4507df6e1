"""A corpus pipeline: quality rules, line dedup, n-gram Jaccard join, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before has kept. All but the last return the
columns of docs as they came, whatever further columns these hold; the last returns a row for each text with its ids.
Stages read doc_id, text and source, and n_chars, if it is there, follows the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm.common import id_key, sieve, staged
from tesserae.llm.jaccard import jaccard_groups
from tesserae.llm.line_dedup import line_dedup
from tesserae.llm.mixing import draw_of, mix, n_words
from tesserae.llm.quality import judge, log_ratios
from tesserae.llm.tokenizer import encode

#: No SQL: the first stage hashes by a function that SQL engines don't share, and the last is no SQL.
ORACLE_SQL = None

#: A line on more than so many percent of a source's documents is boilerplate. Sources are far wider than hosts, so a passage
#: that they share is on a smaller part of them than one of a site's template is.
LINE_PERCENT = 10
#: Near-duplicates share this percentage of their shingles of so many words, at least; op6's own contract is another.
SHINGLE, NEAR_PERCENT = 5, 80


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The row in one column, so that no name of its own can clash, beside the columns that a stage reads."""
    return docs.select(F.struct("*").alias("_row"), *names)


def with_text(docs: DataFrame, text: Column) -> Column:
    row = F.col("_row").withField("text", text)
    return row.withField("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else row


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep; trusted are the documents labelled 1.

    A null or empty text goes, as it has too few words; rows that are alike, or have the same id or none, are judged one by
    one; an empty table stays empty.
    """
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    ratios = log_ratios(docs.select("doc_id", "text"), trusted)
    # A condition that isn't deterministic to the optimizer stays above the measures; else each use of them below it would
    # be written out again, nested, into the filter.
    judged = judge(packed(docs, "text", "doc_id"), ratios).withColumn("_here", F.monotonically_increasing_id() >= 0)
    return judged.where("kept AND _here").select("_row.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without the lines that are boilerplate of their source.

    A null text stays null; a text that loses all its lines is empty; rows without a source are a source of their own; rows
    that are alike count one by one; an empty table stays empty.
    """
    out = line_dedup(packed(docs, "text", F.col("source").alias("_source")), F.col("_source"), percent=LINE_PERCENT)
    return out.select(with_text(docs, F.col("text")).alias("_row")).select("_row.*")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id. Empty texts are groups of one.

    Of rows that are alike in id and text one stays, if that is the group's; a null id counts as the largest; an empty table
    stays empty.
    """
    marked = jaccard_groups(docs.select("doc_id", "text"), n=SHINGLE, percent=NEAR_PERCENT).select(id_key(F.col("doc_id")).alias("_id"), F.col("mark").alias("_mark"), "head")
    # Rows may be alike in id and text: as many stay as are heads. Rows that may be none go to the join, all others stay.
    heads = staged(marked.groupBy("_id", "_mark").agg(F.count_if("head").alias("_heads"), F.count("*").alias("_rows")).where("_heads < _rows").drop("_rows"), "heads")
    met = sieve(packed(docs, id_key(F.col("doc_id")).alias("_id"), F.xxhash64("text").alias("_mark")), heads, ["_id", "_mark"])
    order = W.partitionBy("_id", "_mark").orderBy(F.xxhash64("_row"))
    asked = met.where("_maybe").withColumn("_n", F.row_number().over(order)).join(heads.hint("merge"), ["_id", "_mark"], "left")
    return asked.where("_heads IS NULL OR _n <= _heads").select("_row").union(met.where("NOT _maybe").select("_row")).select("_row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. The one at which a source's budget is cut ends with the last word taken.

    Texts without words are never taken; rows that are alike in id, text and source share what is taken of them; rows without
    a source are a source of their own; an empty table stays empty.
    """
    size = n_words(F.col("text"))
    taken = mix(docs.select("doc_id", "text", "source"), with_draw=True)
    # Rows that are alike take one of a few numbers of words: a number of epochs, one more, or what is left of a budget. Only
    # where these differ are such rows told apart.
    counts = taken.groupBy(F.col("draw").alias("_draw"), id_key(F.col("source")).alias("_source"), "taken").agg(F.count("*").alias("n"))
    shares = counts.groupBy("_draw", "_source").agg(F.sort_array(F.collect_list(F.struct("taken", "n")), asc=False).alias("_shares")).where("_shares[0].taken > 0")
    met = packed(docs, draw_of(F.col("doc_id"), F.col("text")).alias("_draw"), id_key(F.col("source")).alias("_source"), size.alias("_size")).join(shares, ["_draw", "_source"])
    alike = met.where("size(_shares) = 1").withColumn("_taken", F.expr("_shares[0].taken"))
    nth = F.row_number().over(W.partitionBy("_draw", "_source").orderBy(F.xxhash64("_row")))
    ends = F.transform("_shares", lambda s, i: F.struct(s["taken"], F.aggregate(F.slice("_shares", 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("end")))
    apart = met.where("size(_shares) > 1").withColumn("_nth", nth).withColumn("_taken", F.filter(ends, lambda e: F.col("_nth") <= e["end"])[0]["taken"]).drop("_nth")
    met = alike.unionByName(apart).where("_taken > 0").drop("_shares")
    copies = met.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_taken") - 1) / F.col("_size")))))
    left = F.col("_taken") - F.col("_copy") * F.col("_size")
    body = F.col("_row.text")
    pieces = F.regexp_extract_all(body, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0)
    text = F.when(left >= F.col("_size"), body).otherwise(F.array_join(F.slice(pieces, 1, left.cast("int")), ""))
    return copies.select(with_text(docs, text).alias("_row")).select("_row.*")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the hashes of ids and bytes, and the ids, of every row; a null text counts as empty; rows that are
    alike are encoded one by one; an empty table stays empty."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", jaccard_join),
    ("mixing sources", mixing),
    ("byte-level BPE", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
