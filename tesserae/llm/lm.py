"""LM scoring by a hidden Markov model over word classes.

The most frequent training words are classes of their own; every other word, known or not, belongs to a class by its last
two bytes, and the end of a text is a class. A text's probability is that of its classes, by the scaled forward recursion
over the whole text, times that of each word within its class, (c + 1) / (n + v + 1) with the count c of the word and the
tokens n and types v of the class; so all texts' probabilities sum to 1.

Training starts from the classes' shares among all training texts, told apart by fixed noise in each state, and goes on in
rounds of Baum-Welch over all of them until the likelihood of a token rises by less than a stated share, at MOST rounds.
Every task sums the expected counts of its partition, Spark adds them in fixed point, and the driver holds one table of
states by classes, whose size doesn't grow. Within a task, sums run in single precision, so that another partitioning can
change a score in its last digits; reruns over the same partitions agree. Texts are tokenised once: the classes of all
words are written to the shared folder, two bytes each, and rounds and scores read these.

For training, texts are cut into segments, all of which are used; a segment that doesn't begin a text starts from the
states' shares. The score itself is exact over the whole text, however long.

Counts of words grow with the corpus and stay a distributed table. The most frequent are looked up in each worker, up to a
fixed number of words of a fixed length at most; all others are joined.

Defined cases: a null or empty text is the end alone; without training texts all classes are equally likely and all counts
0; a null id counts as an empty one where its remainder is taken; ids may repeat, with any texts: rows are learnt and scored
one by one; ties of frequency are broken by the word's bytes; an empty table gives an empty result; columns other than id
and text are left out.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import ship, staged

ship(__name__)

STATES, OWN_CLASSES, SUFFIX_CLASSES = 8, 8192, 1024
#: Words that workers look up rather than join, and their bytes at most; distinct words a worker counts before it hands them on.
LOOKED_UP, LONGEST, HELD = 1 << 18, 64, 300_000
#: Rounds at most, and the relative rise of the log-likelihood below which they end.
MOST, SETTLED = 20, 1e-3
SEGMENT, BATCH_TOKENS = 256, 1_000_000
FIXED = 1 << 20


def remainder(key: str, by: int) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % by


def words_of(text: bytes | None) -> list[bytes]:
    """bytes.lower() and split() know ASCII only: A-Z, and the six separators."""
    return (text or b"").lower().split()


class Classes(dict):
    """The class of each word: its own, or that of its last bytes."""

    def __init__(self, own: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(own))
        self.n_own, self.end, self.n = len(own), len(own) + SUFFIX_CLASSES, len(own) + SUFFIX_CLASSES + 1

    def __missing__(self, word: bytes) -> int:
        return self.n_own + zlib.crc32(word[-2:]) % SUFFIX_CLASSES

    def __reduce__(self):
        return (Classes, (list(self),))

    def ids(self, words: list[bytes]) -> np.ndarray:
        out = np.empty(len(words) + 1, np.int32)
        out[:-1] = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        out[-1] = self.end
        return out


class Model:
    """pi: of a text's first state, occ: of any; a: from state to state; e: classes by states."""

    def __init__(self, pi: np.ndarray, occ: np.ndarray, a: np.ndarray, e: np.ndarray):
        self.pi, self.occ, self.a, self.e = pi, occ, a, e

    @staticmethod
    def first(share: np.ndarray, states: int) -> Model:
        """What training starts from: each state emits the classes by their shares among all tokens, with noise of a fixed seed."""
        noise = np.random.default_rng(17).gamma(2.0, 0.5, (len(share), states))
        return Model.of_counts(np.zeros(states), np.eye(states) * 50, 1e6 * share[:, None] * noise, share)

    @staticmethod
    def of_counts(pi: np.ndarray, a: np.ndarray, e: np.ndarray, share: np.ndarray) -> Model:
        """From expected counts; share: of each class among all tokens, to which the states' are smoothed."""
        k = len(pi)
        occ = e.sum(0) + 1
        return Model((pi + 1) / (pi.sum() + k), occ / occ.sum(), (a + 1) / (a.sum(1, keepdims=True) + k), (e + 10 * share[:, None]) / (e.sum(0) + 10))


def ragged(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All ids in one array, each sequence's offset, longest first, the number still running at each step, the order."""
    lengths = np.fromiter(map(len, seqs), np.int64, len(seqs))
    order = np.argsort(-lengths, kind="stable")
    offsets = np.concatenate(([0], np.cumsum(lengths)[:-1]))[order]
    running = len(seqs) - np.searchsorted(np.sort(lengths), np.arange(lengths.max()), side="right")
    return np.concatenate(seqs), offsets, running, order


def log_likelihoods(model: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """log10 of each sequence's probability, by the scaled forward recursion, all sequences in step."""
    flat, offsets, running, order = ragged(seqs)
    total = np.zeros(len(seqs))
    alpha = np.broadcast_to(model.pi, (len(seqs), len(model.pi)))
    for t, n in enumerate(running):
        if t:
            alpha = alpha[:n] @ model.a
        alpha = alpha * model.e[flat[offsets[:n] + t]]
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        total[:n] += np.log10(scale)
    out = np.empty(len(seqs))
    out[order] = total
    return out


def expected(model: Model, seqs: list[np.ndarray], first: np.ndarray, into: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
    """Add a batch's expected counts; its log-likelihood. first: which segments begin a text."""
    pi, a, e = into
    flat, offsets, running, order = ragged(seqs)
    first, k = first[order], len(model.pi)
    A, E = model.a.astype(np.float32), model.e.astype(np.float32)
    begins = np.concatenate(([0], np.cumsum(running)))
    at = np.concatenate([offsets[:n] + t for t, n in enumerate(running)])
    seen = flat[at]
    emitted = E[seen]
    alpha, scale = np.empty((len(seen), k), np.float32), np.empty(len(seen), np.float32)
    last = np.where(first[:, None], model.pi, model.occ).astype(np.float32)
    for t, n in enumerate(running):
        i, j = begins[t], begins[t + 1]
        now = (last if t == 0 else last[:n] @ A) * emitted[i:j]
        s = now.sum(1)
        now /= s[:, None]
        alpha[i:j], scale[i:j], last = now, s, now
    gamma, xi = np.empty_like(alpha), np.zeros((k, k))
    beta = np.ones((running[-1], k), np.float32)
    for t in range(len(running) - 1, -1, -1):
        i, j = begins[t], begins[t + 1]
        gamma[i:j] = alpha[i:j] * beta
        if t:
            ahead = emitted[i:j] * beta / scale[i:j, None]
            xi += alpha[begins[t - 1] : begins[t - 1] + (j - i)].T @ ahead
            before = np.ones((running[t - 1], k), np.float32)
            before[: j - i] = ahead @ A.T
            beta = before
    pi += gamma[: running[0]][first].sum(0)
    a += xi * model.a
    for s in range(k):
        e[:, s] += np.bincount(seen, gamma[:, s], len(e))
    return float(np.log(scale, dtype=float).sum())


def segments(ids: np.ndarray) -> list[np.ndarray]:
    return [ids[i : i + SEGMENT] for i in range(0, len(ids), SEGMENT)]


def texts_in(batch: pa.RecordBatch, name: str = "_text") -> list[bytes | None]:
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def hand_on() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])
        held.clear()
        return out

    for batch in batches:
        for text in texts_in(batch):
            held.update(words_of(text))
            if len(held) > HELD:
                yield hand_on()
    if held:
        yield hand_on()


def class_sizes(classes: Classes):
    """Tokens and types of the suffix classes, from the table of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(classes.n, np.int64), np.zeros(classes.n, np.int64)
        for batch in batches:
            ids = np.fromiter(map(classes.__getitem__, batch.column(0).to_pylist()), np.int64, batch.num_rows)
            np.add.at(n, ids, batch.column(1).to_numpy())
            np.add.at(v, ids, 1)
        at = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(v[at])], ["cls", "n", "v"])

    return run


def width(n: int) -> str:
    """The integers that classes are written as."""
    return "<u2" if n <= 1 << 16 else "<u4"


TOKENS = "rid long, n_tokens long, known long, base double, own double, rare array<binary>, ids binary"


def tokenised(classes: Classes, log_of: dict[bytes, float], has_end: bool):
    """Each text's classes, what is due for its words that are looked up (base: log10(c + 1) of all; own: of those within
    classes of several words), and its other words. log_of: log10(c + 1) of the words looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid, kind = TaskContext.get().partitionId() << 40, width(classes.n)
        get, n_own = log_of.get, classes.n_own
        for batch in batches:
            rows, begun, size = [], 0, 0
            for i, text in enumerate(texts_in(batch)):
                ws = words_of(text)
                logs = list(map(get, ws))
                rare = [w for w, x in zip(ws, logs) if x is None] if None in logs else []
                ids = classes.ids(ws)
                common = sum(x for x in logs if x is not None) if rare else sum(logs)
                own = sum(x for x, c in zip(logs, ids.tolist()) if c >= n_own and x is not None)
                rows.append((rid, len(ids), len(ws) - len(rare) + has_end, common, own, rare, ids.astype(kind).tobytes()))
                rid, size = rid + 1, size + len(ids)
                if size > BATCH_TOKENS or i + 1 == batch.num_rows:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.binary())
                    made = [pa.array(list(x), t) for x, t in zip(zip(*rows), kinds)]
                    head = [batch.column(c).slice(begun, len(rows)) for c in ("_key", "_train")]
                    yield pa.RecordBatch.from_arrays(head + made, ["_key", "_train", "rid", "n_tokens", "known", "base", "own", "rare", "ids"])
                    rows, begun, size = [], i + 1, 0

    return run


def expected_in(model: Model):
    """A partition's expected counts in fixed point: a row for each class, each state's transitions, the starts, and the
    log-likelihood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, k = model.e.shape
        into, loglik = (np.zeros(k), np.zeros((k, k)), np.zeros((n, k))), 0.0
        seqs, first, tokens = [], [], 0
        for batch in batches:
            for ids in texts_in(batch, "ids"):
                own = segments(np.frombuffer(ids, width(n)))
                seqs += own
                first += [True] + [False] * (len(own) - 1)
                tokens += sum(map(len, own))
                if tokens >= BATCH_TOKENS:
                    loglik += expected(model, seqs, np.array(first), into)
                    seqs, first, tokens = [], [], 0
        if seqs:
            loglik += expected(model, seqs, np.array(first), into)
        last = np.zeros(k)
        last[0] = loglik
        table = np.rint(np.concatenate([into[2], into[1], into[0][None], last[None]]) * FIXED).astype(np.int64)
        rows = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(rows)] + [pa.array(np.ascontiguousarray(table[rows, s])) for s in range(k)], ["row"] + [f"s{s}" for s in range(k)])

    return run


def trained(train: DataFrame, share: np.ndarray, states: int, most: int = MOST, settled: float = SETTLED) -> tuple[Model, list[float]]:
    """A model of all training texts, and the log-likelihood of each round. train: ids, the classes of each text's tokens."""
    model, curve, n = Model.first(share, states), [], len(share)
    columns = [f"s{s}" for s in range(states)]
    schema = "row long, " + ", ".join(f"{c} long" for c in columns)
    while len(curve) < most:
        got = train.select("ids").mapInArrow(expected_in(model), schema).groupBy("row").agg(*(F.sum(c).alias(c) for c in columns)).collect()
        table = np.zeros((n + states + 2, states))
        for r in got:  # a row for each class and state
            table[r[0]] = r[1:]
        table /= FIXED
        model = Model.of_counts(table[-2], table[n:-2], table[:n], share)
        curve.append(table[-1, 0])
        if len(curve) > 1 and curve[-1] - curve[-2] < settled * abs(curve[-2]):
            break
    return model, curve


def scored_by(model: Model, within: np.ndarray, log_all: float, end_log: float):
    """Scores but for the rare words' log10(c + 1), which is due in base and model alike. within: of each class, log10 of
    what its words' c + 1 are divided by; log_all: the same for base."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begun, size = 0, 0
            lengths = batch.column("n_tokens").to_numpy()
            for i, n in enumerate(lengths.tolist()):
                size += n
                if size >= 4 * BATCH_TOKENS or i + 1 == batch.num_rows:
                    part = batch.slice(begun, i + 1 - begun)
                    seqs = [np.frombuffer(x, width(len(within))) for x in texts_in(part, "ids")]
                    inner = np.array([within[s].sum() for s in seqs])
                    own, base = part.column("own").to_numpy(), part.column("base").to_numpy()
                    made = [pa.array(base + end_log - lengths[begun : i + 1] * log_all), pa.array(log_likelihoods(model, seqs) + own - inner)]
                    names = ["_key", "rid", "n_tokens", "known"]
                    yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + made, [*names, "base", "model"])
                    begun, size = i + 1, 0

    return run


def lm_score(docs: DataFrame, training: Column, text: str = "text", key: str = "doc_id", states: int = STATES, own_classes: int = OWN_CLASSES, most: int = MOST, looked_up: int = LOOKED_UP) -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score and score of every row; it learns from the rows where training holds."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.coalesce(training, F.lit(False)).alias("_train"))
    train = rows.where("_train")
    counts = staged(train.select("_text").mapInArrow(counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")
    n_docs = train.count()
    n_words, n_types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_all, v_all = n_words + n_docs, n_types + (n_docs > 0)
    top = counts.where(F.octet_length("word") <= LONGEST).orderBy(F.desc("c"), "word").limit(looked_up).toArrow()
    by_count = sorted(zip((-x for x in top["c"].to_pylist()), top["word"].to_pylist()))
    classes = Classes([w for _, w in by_count[:own_classes]])
    log_of = {w: math.log10(1 - c) for c, w in by_count}
    # Classes that are one word, or the end, have nothing within; the end counts n_docs.
    size, types = np.zeros(classes.n), np.zeros(classes.n)
    for r in counts.mapInArrow(class_sizes(classes), "cls long, n long, v long").groupBy("cls").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        size[r.cls], types[r.cls] = r.n, r.v
    size[classes.end] = n_docs
    within = np.where(np.arange(classes.n) < classes.n_own, 0.0, np.log10(size + types + 1))
    within[classes.end] = 0.0
    share = (size + 1) / (size.sum() + classes.n)

    kind = rows.schema["_key"].dataType.simpleString()
    tokens = staged(rows.mapInArrow(tokenised(classes, log_of, n_docs > 0), f"_key {kind}, _train boolean, {TOKENS}"), "tokens")
    model, _ = trained(tokens.where("_train"), share, states, most)

    log_all, end_log = math.log10(n_all + v_all + 1), math.log10(n_docs + 1)
    scored = tokens.select("_key", "rid", "n_tokens", "known", "base", "own", "ids").mapInArrow(scored_by(model, within, log_all, end_log if n_docs else 0.0), f"_key {kind}, rid long, n_tokens long, known long, base double, model double")
    # log10(c + 1) in fixed point, so that sums don't depend on their order.
    rare = tokens.select("rid", F.explode("rare").alias("word")).join(counts, "word", "left")
    due = rare.groupBy("rid").agg(F.sum(F.round(F.log10(F.coalesce("c", F.lit(0)) + 1) * 1e12).cast("long")).alias("due"), F.count("c").alias("more"))
    out = scored.join(due, "rid", "left")
    extra = F.coalesce(F.col("due") / 1e12, F.lit(0.0))
    return out.select(F.col("_key").alias(key), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + extra).alias("base_score"), (F.col("model") + extra).alias("score"))
