"""Whitening, packing and codes against brute force and on the cases that their docstrings define."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesserae.llm import codes, packing, whitening
from tesserae.llm import queries as Q

SF = "/root/testdata/sf0.001"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
DDL = "vec_id long, embedding array<float>, label int, x string, whitened string, code string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "w", "c") for i, v, label in rows], DDL)


def brute_whitening(rows):
    """rows: id and entries. By whole numbers and fractions as far as they go."""
    x = [(i, tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v)) for i, v in rows]
    fit = sorted({v for _, v in x})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(v, s)] for v in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    total = Fraction(sum((n * c - t) ** 2 for v in fit for c, t in zip(v, s)), n**3)
    deviations = [(i, sum((n * c - t) ** 2 for c, t in zip(v, s))) for i, v in x]
    white = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(v, s)] for _, v in x]) @ axes[:, order] / np.sqrt(np.maximum(values[order], 1e-300))
    return n, deviations, white, values[order] / float(total)


def test_whitening_is_that_of_the_definition(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    n, deviations, white, explained = brute_whitening(rows)
    got = {}
    for r in Q.op11_whitening(spark, SF).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == len(rows) and all(sorted(v) == list(range(1, 17)) for v in got.values())
    for k in range(16):
        mine = np.array([got[i][k + 1].whitened for i, _ in rows])
        sign = np.sign(mine @ white[:, k])
        assert np.abs(mine - sign * white[:, k]).max() < 1e-9
        assert got[rows[0][0]][k + 1].explained == pytest.approx(explained[k], rel=1e-9)
    assert all(r.deviation == d and r.n == n for (i, d) in deviations for r in got[i].values())
    assert {r.identity_error for v in got.values() for r in v.values()} == {got[rows[0][0]][1].identity_error} and got[rows[0][0]][1].identity_error < 1e-9


def test_whitening_counts_copies_once_and_leaves_out_what_it_cannot_compare(spark):
    r = np.random.default_rng(3)
    base = [r.normal(size=5).astype(np.float32).tolist() for _ in range(40)]
    rows = [(i, v, 0) for i, v in enumerate(base)] + [(100 + i, base[0], 1) for i in range(60)] + [(None, base[1], 1), (7, base[2], 1)]
    odd = [(900, None, 0), (901, [1.0, None, 0.0, 0.0, 0.0], 0), (902, [float("nan")] * 5, 0), (903, [float("inf")] + [0.0] * 4, 0)]
    out, found = whitening.whiten(vectors(spark, rows + odd))
    n, _, white, explained = brute_whitening([(i, v) for i, v in enumerate(base)])
    assert found.n == n == 40 and len(found.axes) == 5 and found.explained == pytest.approx(list(explained), rel=1e-9) and sum(found.explained) == pytest.approx(1)
    got = out.collect()
    assert len(got) == len(rows) and {x.vec_id for x in got}.isdisjoint({900, 901, 902, 903})
    copies = {(tuple(x.whitened), x.deviation) for x in got if x.vec_id is not None and x.vec_id >= 100}
    assert len(copies) == 1 and copies == {(tuple(x.whitened), x.deviation) for x in got if x.vec_id == 0}


def test_whitening_without_variance_and_of_few_dimensions(spark):
    assert whitening.whiten(vectors(spark, []))[0].count() == 0
    assert whitening.whiten(vectors(spark, [(1, None, 0)]))[0].collect()[0:] == []
    same, found = whitening.whiten(vectors(spark, [(i, [0.5, 0.5], 0) for i in range(9)]))
    assert found is None and [tuple(r.whitened) for r in same.collect()] == [()] * 9
    # The shorter ends in zeros; of three dimensions that vary in two directions there are two components.
    rows = [(1, [1.0, 1.0, 0.0], 0), (2, [2.0, 2.0], 0), (3, [-1.0, -1.0, 3.0], 0), (4, [], 0), (5, [0.0, 0.0, 1.0], 0)]
    out, found = whitening.whiten(vectors(spark, rows))
    assert found.n == 5 and len(found.variances) == 2 and found.identity_error < 1e-9 and sum(found.explained) == pytest.approx(1)
    assert all(len(r.whitened) == 2 for r in out.collect())


def test_deviations_are_exact_where_doubles_are_not(spark):
    rows = [(i, [float(1 << 20) + i, 0.25 * i], 0) for i in range(50)]
    _, deviations, _, _ = brute_whitening([(i, v) for i, v, _ in rows])
    out, _ = whitening.whiten(vectors(spark, rows))
    assert {r.vec_id: int(r.deviation) for r in out.collect()} == dict(deviations)


def brute_codes(rows, parts=8, entries=16, rounds=6):
    x = [(i, [int(np.floor(4096 * float(c))) for c in v]) for i, v in rows]
    w = len(x[0][1]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v in x]
    first = [c for _, c in sorted(zip([i for i, _ in x], cut))][:entries]
    books = [[list(c[p]) for c in first] for p in range(parts)]
    near = lambda q, book: min((sum((a - b) ** 2 for a, b in zip(q, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(c[p], books[p])[1] for c in cut]
            for k in range(len(books[p])):
                if mine := [c[p] for c, o in zip(cut, own) if o == k]:
                    books[p][k] = [sum(y) // len(mine) for y in zip(*mine)]
    found = {}
    for (i, _), c in zip(x, cut):
        best = [near(c[p], books[p]) for p in range(parts)]
        found[i] = ("".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best))
    return found, hashlib.sha256(",".join(str(y) for b in books for e in b for y in e).encode()).hexdigest()


def test_codes_are_those_of_the_definition(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    labels = {r.vec_id: r.label for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    expected, digest = brute_codes(rows)
    got = Q.op13_vector_codes(spark, SF).collect()
    assert {r.vec_id: (r.code, r.error) for r in got} == expected and {r.codebooks_sha256 for r in got} == {digest}
    totals = {}
    for i, (_, e) in expected.items():
        totals[labels[i]] = totals.get(labels[i], 0) + e
    assert all(r.label_error == totals[labels[r.vec_id]] for r in got)


def test_codes_of_ties_copies_nulls_and_few_rows(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.integers(-2, 3, 16).astype(float).tolist(), None if i % 3 else 1) for i in range(90)]
    rows += [(200 + i, rows[0][1], 2) for i in range(50)]
    odd = [(900, None, 1), (901, [None] * 16, 1), (902, [float("-inf")] * 16, None)]
    coded, books = codes.compress(vectors(spark, rows + odd), carry=["label"])
    got = {x.vec_id: x for x in codes.error_by(coded, "label").collect()}
    expected, digest = brute_codes([(i, v) for i, v, _ in rows])
    assert {i: (x.code, x.error) for i, x in got.items()} == expected and codes.codebooks_sha256(books) == digest
    sums = {k: sum(expected[i][1] for i, _, label in rows if label == k) for k in (None, 1, 2)}
    assert all(got[i].label_error == sums[label] for i, _, label in rows)
    # Fewer rows than entries, a null id last, a length that parts don't divide, a shorter and an empty vector, clashing names.
    few = [(None, [1.0] * 9, None), (2, [0.5] * 9, None), (2, [], None), (1, [-0.1], None)]
    coded, books = codes.compress(vectors(spark, few), carry=["x", "code", "whitened"][:1])
    assert books.shape == (8, 4, 2) and [x.error for x in coded.collect()] == [0, 0, 0, 0]
    assert books[0, :, 0].tolist() == [-410, 0, 2048, 4096]
    none, books = codes.compress(vectors(spark, odd))
    assert none.count() == 0 and books.shape == (8, 0, 1)
    with pytest.raises(Exception, match="leave 64 bits"):
        codes.compress(vectors(spark, [(1, [1e9] * 8, 1), (2, [0.0] * 8, 1)]))[0].collect()


def test_va_file_refines_few_and_never_misses():
    r = np.random.default_rng(8)
    for n, width, spread in ((1, 1, 3), (2, 3, 2), (16, 8, 4000), (100, 4, 50), (256, 16, 10)):
        entries, parts = r.integers(-spread, spread + 1, (n, width)), r.integers(-spread, spread + 1, (5000, width))
        file = codes.VAFile(entries)
        index, distance, refined = file.nearest(parts)
        every = ((parts[:, None, :] - entries[None]) ** 2).sum(2)
        assert (index == every.argmin(1)).all() and (distance == every.min(1)).all()
        least, most = file.bounds(parts)
        assert (least <= every).all() and (every <= most).all()
        if n == 16:
            assert refined < 0.4 * every.size


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORD_BPE)


ODD = [None, "", "   ", "don't I'LL 'S ''s ...'s", "ÀÉ ß x²y ½\x85a\xa0b\x1cc\x0bd", "日本語 Ω ΑΣ İ ſ 's ﬁ é ’s ́", "a<|startoftext|>B <|endoftext|> <|x|>", "x" * 3000, "Σ😀\x00", "ab " * 9000, "日本 " * 5000]


def test_pieces_are_those_of_the_tokenizer(spark, tokenizer):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ODD
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, piece string")
    rows = {}
    for r in packing.pieces(docs, WORD_BPE, with_ids=True).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        mine = sorted(rows[i], key=lambda r: r.piece)
        assert b"".join(r.ids for r in mine) == ids
        assert [r.piece for r in mine] == list(range(len(mine))) and [r.start for r in mine] == list(range(0, len(ids) // 4, 4096))
        assert all(r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids) for r in mine) and all(r.length == 4096 for r in mine[:-1])


def test_long_stretches_are_cut_before_white_space(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 50)
    monkeypatch.setattr(packing, "REMEMBERED", 40)
    codec = packing.Codec(WORD_BPE)
    assert codec.by_words
    texts = [t or "" for t in ODD] * 2 + ["one two  three\n\nfour, five; six! " * 30]
    assert codec.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    other = packing.Codec(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_words and other.encode(["a b"]) == [np.array(other.tokenizer.encode("a b").ids, "<u4").tobytes()]


def plain_best_fit(lengths, capacity, most):
    """The same rule by looking through all open bins: (bin, offset) of each length."""
    free, age, out, made = {}, {}, [], 0
    for k, n in enumerate(lengths):
        fits = [b for b in free if free[b] >= n]
        if fits:
            b = min(fits, key=lambda b: (free[b], -age[b]))
        else:
            if len(free) == most:
                del free[min(free, key=lambda b: (free[b], -age[b]))]
            b, made = made, made + 1
            free[b] = capacity
        out.append((b, capacity - free[b]))
        free[b] -= n
        age[b] = k
        if not free[b]:
            del free[b]
    return out


def test_bins_are_best_fit_with_a_bound(spark):
    r = np.random.default_rng(2)
    for capacity, most in ((10, 1), (10, 3), (64, 8), (4096, 50)):
        lengths = r.integers(1, capacity + 1, 3000).tolist()
        bins = packing.Bins(capacity, most)
        assert [bins.put(n) for n in lengths] == plain_best_fit(lengths, capacity, most)
    for wrong in (0, 11):
        with pytest.raises(ValueError, match="does not go"):
            packing.Bins(10, 3).put(wrong)


def whole(rows, capacity=4096):
    """Sequences are gapless from 0 and no longer than they may be; how many there are."""
    found = {}
    for r in rows:
        found.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in found.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(found)


def test_packing_of_documents(spark, tokenizer):
    rows = Q.op12_best_fit_packing(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    total = 0
    for d in docs:
        total += len(tokenizer.encode(d.text, add_special_tokens=False).ids) + 1
    assert sum(r.length for r in rows) == total and {r.doc_id for r in rows} == {d.doc_id for d in docs}
    assert whole(rows) <= 1.02 * total / 4096 + 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, Q.op12_best_fit_packing(spark, SF).collect()))


def test_packing_of_many_groups_and_sequences(spark):
    lengths = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), (1 + F.pmod(F.xxhash64("id"), F.lit(900))).alias("length"), F.lit("x").alias("offset"))
    same = lengths.union(lengths.where("doc_id = 3")).union(lengths.selectExpr("CAST(NULL AS BIGINT)", "piece", "4096L", "offset").limit(50))
    rows = packing.pack(same, group=1 << 20).collect()
    total = sum(r.length for r in rows)
    assert len(rows) == 20_051 and total / 4096 <= whole(rows) <= 1.005 * total / 4096 + 9
    assert len({r.sequence_id >> 40 for r in rows}) == -(-total >> 20)
    # Few open bins cost sequences, but none is too long.
    assert whole(packing.pack(lengths, most_open=1).collect()) > 1.05 * sum(r.length for r in lengths.collect()) / 4096
    assert packing.pack(lengths.limit(0)).collect() == []
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (2, None), (None, "d " * 5000)], "doc_id long, text string")
    packed = packing.pack(packing.pieces(docs, WORD_BPE, with_ids=True))
    out = packing.sequences(packed).collect()
    by = {}
    for r in packed.collect():
        by.setdefault(r.sequence_id, []).append(r)
    assert {r.sequence_id: (bytes(r.ids), r.starts) for r in out} == {k: (b"".join(bytes(r.ids) for r in sorted(v, key=lambda r: r.offset)), [r.offset for r in sorted(v, key=lambda r: r.offset)]) for k, v in by.items()}
    assert sum(len(r.ids) for r in out) == 4 * (4 + 1 + 1 + 5001)
