"""Quality rules: a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Word unigrams and bigrams are hashed into a fixed number of buckets. The buckets of all documents make one multinomial,
those of the trusted documents another, smoothed towards the first by so many counts that follow it. A document's score is
the mean over its n-grams of ln(p_target / p_raw): above 0 it is more like the target. A document is kept if it passes the
plain rules and its score reaches the threshold.

No document is judged by counts of its own: documents fall into folds by the hash of their id, and each fold is judged by
the counts of all the others, raw and trusted. So trusted documents get no bonus for having been counted. Counts are exact
integers, and a document's ratios are added in the order of its text, so reruns agree.

Defined cases: a null or empty text has no words, score 0, and fails the plain rules; a fold without trusted rows in the
others gets score 0, and only the plain rules decide; a label with null id or null quality trusts nothing; a document that
has several labels is trusted if any is 1; documents with a null id are never trusted; repeated rows are counted and judged
one by one, all in the fold of their id; an empty table gives an empty result; other columns stay as they are, whatever
their names, but those of a result's name are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm.common import SPACE, id_key, sieve, staged, words

#: Buckets of the hashed n-grams, and folds: these bound the tables of counts, whatever the corpus. Counts for each bucket
#: that follow the raw corpus, on average.
BUCKETS, FOLDS, PRIOR = 10_000, 5, 30
#: Mean log ratio a document must reach.
THRESHOLD = -0.03
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(rows: DataFrame) -> DataFrame:
    """rows with words, and the plain measures of text."""
    body = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = rows.withColumns({"words": words(F.col("text")), "lines": lines})
    n = F.size("words")
    # The 3-word windows sorted by hash: equal ones stand side by side. Sorted again by place, each window covers three
    # words or as many as lie before the next one's. Texts whose windows all differ need no sort.
    hashes = F.when(n >= 3, F.transform(F.slice("words", 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("words", i + 1), F.get("words", i + 2))))
    out = out.withColumn("hashes", hashes)
    placed = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("windows", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    twin = lambda x, j: (F.get("windows", j - 1)["h"] == x["h"]) | (F.get("windows", j + 1)["h"] == x["h"])
    out = out.withColumn("twins", F.sort_array(F.transform(F.filter("windows", lambda x, j: F.coalesce(twin(x, j), F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(F.transform("twins", lambda p, j: F.least(F.coalesce(F.get("twins", j + 1) - p, F.lit(3)), F.lit(3))), F.lit(0), lambda a, x: a + x)
    return out.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.regexp_replace(body, f"{SPACE}+", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(body, "[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": covered.cast("long"),
    }).drop("lines", "hashes", "windows", "twins")


def buckets(word_list: Column, n: int) -> Column:
    """The buckets of all unigrams, then of all bigrams."""
    one = F.transform(word_list, lambda x: F.pmod(F.xxhash64(x), F.lit(n)).cast("int"))
    return F.concat(one, F.transform(F.slice(word_list, 2, F.greatest(F.size(word_list) - 1, F.lit(0))), lambda x, i: F.pmod(F.xxhash64(F.get(word_list, i), x), F.lit(n)).cast("int")))


def fold_of(key: Column, folds: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), id_key(key)), F.lit(folds)).cast("int")


def log_ratios(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", n: int = BUCKETS, folds: int = FOLDS) -> DataFrame:
    """fold, ratios: ln(p_target / p_raw) of each bucket by the counts of all other folds, a row for each fold.

    trusted: a frame with the ids of the target's documents. Texts are shuffled only to learn which of them are trusted, and
    a sieve keeps most of the others out. Every text is cut into n-grams once, which are counted before they are shuffled.
    """
    ids = staged(trusted.select(F.col(trusted.columns[0]).alias("id")).where("id IS NOT NULL").distinct().withColumn("trusted", F.lit(True)), "trusted")
    bare = sieve(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), ids, ["id"])
    # Both sides grow with the corpus, so neither is broadcast even where it would still be small enough.
    asked = bare.where("_maybe").join(ids.hint("merge"), "id", "left").select("id", "text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    rows = bare.where("NOT _maybe").select("id", "text", F.lit(False).alias("trusted")).union(asked)
    # A bucket's place tells its fold, too: one number to group by.
    grams = rows.select("trusted", (fold_of(F.col("id"), folds) * n).alias("from"), words(F.col("text")).alias("w")).select("trusted", "from", F.explode(buckets(F.col("w"), n)).alias("b"))
    counts = grams.select((F.col("from") + F.col("b")).alias("id"), F.col("trusted").cast("long").alias("t")).groupBy("id").agg(F.count("*").alias("r"), F.sum("t").alias("t"))
    table = docs.sparkSession.range(folds * n).select(F.col("id").cast("int").alias("id")).join(staged(counts, "counts"), "id", "left")
    table = table.select(F.floor(F.col("id") / n).cast("int").alias("fold"), (F.col("id") % n).alias("b"), F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("t", F.lit(0)).alias("t"))
    # From here on there are folds * n rows.
    others = table.select("fold", "b", *((F.sum(c).over(W.partitionBy("b")) - F.col(c)).alias(c) for c in "rt"))
    others = others.join(F.broadcast(others.groupBy("fold").agg(*(F.sum(c).alias(f"all_{c}") for c in "rt"))), "fold")
    share = (F.col("r") + 1) / (F.col("all_r") + n)
    ratio = F.when(F.col("all_t") > 0, F.log((F.col("t") / share + PRIOR * n) / (F.col("all_t") + PRIOR * n))).otherwise(0.0)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("b", ratio.alias("x")))), lambda p: p["x"])
    return staged(others.groupBy("fold").agg(listed.alias("ratios")), "ratios")


def judge(docs: DataFrame, ratios: DataFrame, text: str = "text", key: str = "doc_id", n: int = BUCKETS, folds: int = FOLDS, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """docs with the plain measures, base_failed, llr and kept. ratios: from log_ratios() with the same n and folds."""
    # The row goes along in one column, so that no name of its own can clash. Of ratios there is a row for each fold.
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"), fold_of(F.col(key), folds).alias("fold"))
    out = measured(rows.join(F.broadcast(ratios), "fold", "left")).withColumn("grams", buckets(F.col("words"), n))
    total = F.aggregate("grams", F.lit(0.0), lambda a, b: a + F.get("ratios", b))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out = out.withColumns({"base_failed": failed, "llr": F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(0.0)})
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    made = [*MEASURES, "base_failed", "llr", "kept"]
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in made), *made)


def quality_rules(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    return judge(docs, log_ratios(docs, trusted, text, key), text, key, threshold=threshold)
