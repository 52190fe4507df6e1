"""Toxicity by a counterfactual-regularised classifier.

A logistic regression on the words that a text holds. In every labelled text that names a group, the identity terms are
swapped for others of their kind; the loss adds the squared change that the swaps make in the score, so a mere mention
of a group can't carry the verdict. It is fitted on a bounded sample of labelled rows; of the sample's words, those enter
that go with the label most clearly, up to a fixed number.

Defined cases: a null or empty text has no words and gets the score of the intercept; a null label or id teaches nothing; a
document with several labels is toxic if any is 1; without labelled rows, or with one label only, every score is the share
of toxic rows with one of each kind added; rows that are alike in id and text teach once and are scored one by one; rows of
one id with other texts are rows of their own; of more labelled rows than the sample takes, those with the least hashes of
the id enter, then of the text; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import ship, staged

ship(__name__)

#: Labelled rows that the classifier is fitted on at most, words that it knows at most, rows that a word needs, and the
#: least log-likelihood ratio of a word with the label.
SAMPLE, FEATURES, MIN_ROWS, MIN_G = 20_000, 4096, 5, 20.0
CUT, PENALTY, RIDGE, ROUNDS = 0.7, 1.0, 1e-4, 400

#: Identity terms by kind (fixed values); a term is swapped for the next of its line.
IDENTITY = (
    ("woman", "man", "girl", "boy"),
    ("women", "men", "girls", "boys"),
    ("female", "male", "nonbinary", "transgender"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual"),
    ("black", "white", "asian", "latino", "arab", "indigenous"),
    ("american", "mexican", "chinese", "indian", "african", "european"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("blind", "deaf", "disabled", "elderly"),
)
SWAP = {term: line[(i + 1) % len(line)] for line in IDENTITY for i, term in enumerate(line)}
WORDS = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> set[str]:
    return set(WORDS.findall((text or "").lower()))


def swapped(words: set[str]) -> set[str]:
    return {SWAP.get(w, w) for w in words}


def seen_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [sorted(words_of(x.as_py())) for x in batch.column("_text")]
        names = ["_key", "_mark", "toxic"]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(words, pa.list_(pa.string()))], [*names, "words"])


class Classifier:
    def __init__(self, words: list[str], weights: np.ndarray, intercept: float):
        self.weight = dict(zip(words, weights.tolist()))
        self.intercept = intercept

    def score(self, text: str | None) -> float:
        known = self.weight.keys() & words_of(text)
        z = self.intercept + math.fsum(self.weight[w] for w in known)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


class Loss:
    """Mean logistic loss, ridge, and penalty times the mean squared change of the logit under the swaps."""

    def __init__(self, words: list[str], rows: list[list[str]], toxic: np.ndarray, penalty: float):
        self.at, self.toxic, self.penalty, self.n = {w: i for i, w in enumerate(words)}, toxic, penalty, len(rows)
        naming = [set(own) for own in rows if any(w in SWAP for w in own)]
        self.n_naming, self.held = len(naming), self.sparse(rows)
        self.minus, self.plus = self.sparse(naming), self.sparse([swapped(own) for own in naming])

    def sparse(self, sets) -> tuple[np.ndarray, np.ndarray]:
        """Row and word of each word that is known."""
        pairs = [(r, self.at[w]) for r, own in enumerate(sets) for w in own if w in self.at]
        return (np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64))

    def of(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
        """The loss and its gradient, the intercept's last."""
        k, (r, f) = len(w), self.held
        z = np.clip(b + np.bincount(r, w[f], self.n), -500, 500)
        loss = np.logaddexp(0, z).mean() - (z * self.toxic).mean() + RIDGE / 2 * (w @ w)
        off = (1 / (1 + np.exp(-z)) - self.toxic) / self.n
        grad = np.bincount(f, off[r], k) + RIDGE * w
        if self.n_naming:
            change = np.bincount(self.plus[0], w[self.plus[1]], self.n_naming) - np.bincount(self.minus[0], w[self.minus[1]], self.n_naming)
            loss += self.penalty * (change @ change) / self.n_naming
            change *= 2 * self.penalty / self.n_naming
            grad += np.bincount(self.plus[1], change[self.plus[0]], k) - np.bincount(self.minus[1], change[self.minus[0]], k)
        return loss, np.append(grad, off.sum())


def fitted(words: list[str], rows: list[list[str]], toxic: np.ndarray, penalty: float = PENALTY) -> Classifier:
    """By Adam over all rows."""
    loss = Loss(words, rows, toxic, penalty)
    w, b = np.zeros(len(words)), math.log((toxic.sum() + 1) / (len(rows) - toxic.sum() + 1))
    m, v = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for step in range(1, ROUNDS + 1):
        _, g = loss.of(w, b)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Classifier(words, w, b)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE, penalty: float = PENALTY) -> Classifier:
    """labels: key and toxic. Only the sample's rows are read with their words; no more than sample ids, and no more than sample
    pairs of an id and a text's hash, are broadcast, and no more than sample rows reach the driver."""
    known = labels.where(f"`{key}` IS NOT NULL AND toxic IS NOT NULL").groupBy(key).agg(F.max("toxic").cast("int").alias("toxic"))
    ids = known.orderBy(F.xxhash64(F.col(key)), key).limit(sample)
    all_rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(text).alias("_mark"))
    marked = all_rows.select("_key", "_mark").join(F.broadcast(ids.withColumnRenamed(key, "_key")), "_key").distinct()
    picked = staged(marked.orderBy(F.xxhash64("_key"), "_key", "_mark").limit(sample), "picked")
    rows = all_rows.join(F.broadcast(picked), ["_key", "_mark"]).select("_key", "_mark", "_text", "toxic")
    kind = rows.schema["_key"].dataType.simpleString()
    words = rows.mapInArrow(seen_words, f"_key {kind}, _mark long, toxic int, words array<string>")
    rows = staged(words.dropDuplicates(["_key", "_mark"]).select("toxic", "words"), "labelled")
    n, n_toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < n_toxic < n:
        return Classifier([], np.zeros(0), math.log((n_toxic + 1) / (n - n_toxic + 1)))
    by_word = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).where(F.col("n") >= MIN_ROWS)
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    k, rest, p = F.col("k"), F.col("n") - F.col("k"), n_toxic / n
    g = 2 * (part(k, F.col("n") * p) + part(rest, F.col("n") * (1 - p)) + part(n_toxic - k, (n - F.col("n")) * p) + part(n - n_toxic - rest, (n - F.col("n")) * (1 - p)))
    chosen = [x.word for x in by_word.withColumn("g", g).where(F.col("g") >= MIN_G).orderBy(F.desc("g"), "word").limit(FEATURES).collect()]
    # Of the sample's rows, the driver sees the chosen words and the identity terms only.
    keep = F.array(*(F.lit(x) for x in sorted({*chosen, *SWAP})))
    taught = rows.select("toxic", F.array_intersect("words", keep).alias("words")).collect()
    taught.sort(key=lambda x: (x.toxic, x.words))
    return fitted(sorted({*chosen}), [x.words for x in taught], np.array([x.toxic for x in taught], float), penalty)


def scored(model: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array([model.score(x) for x in batch.column("_text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("_key"), score], ["_key", "score"])

    return run


def toxicity(docs: DataFrame, model: Classifier, text: str = "text", key: str = "doc_id", cut: float = CUT) -> DataFrame:
    """key, score and predicted of every row."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    out = rows.mapInArrow(scored(model), f"_key {rows.schema['_key'].dataType.simpleString()}, score double")
    return out.select(F.col("_key").alias(key), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def held_out(key: str, by: int = 3, at: int = 1) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % by == at
