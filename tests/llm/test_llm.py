"""The operators against brute force on small tables, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tesserae.llm import embedding, jaccard, licenses, line_dedup, lm, mixing, quality, tokenizer, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string"


def docs(spark, rows):
    """(doc_id, text, source) rows, with columns whose names the operators use."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "mine", "mine") for i, t, s in rows], DDL)


def prose(draw, n, words=400):
    return " ".join(f"w{int(draw.random() ** 2 * words)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(3)
    rows = [(i, prose(draw, draw.choice([3, 60, 90, 200])) + ("\nShared line here.\n" if i % 3 else ""), f"s{i % 4}") for i in range(60)]
    rows += [(60, None, None), (61, "", "s1"), (62, " \t\n ", "s1"), (63, "a b a b a b a b", "s2"), (64, prose(draw, 20_000), "s0"), (5, rows[5][1], "s1"), (5, rows[5][1], "s1"), (None, rows[6][1], "s2")]
    rows += [(70 + i, rows[8][1] + f" tail{i}", "s3") for i in range(6)]
    return rows


# 1 ------------------------------------------------------------------------------------------------------------------


def base(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def chained(*words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h - (h >> 63 << 64)


def bucket(*words):
    return chained(*words) % quality.BUCKETS


def fold(key):
    return chained("fold", "null" if key is None else f"id {key}") % quality.FOLDS


def test_quality(spark, corpus):
    rows = [*corpus, (100, "x y z x y z q x y z", "s"), (101, "a a a a", "s"), (102, "l1 #\nl1 #\n\n\nl2 é|\n", "s")]
    trusted = spark.createDataFrame([(i,) for i in range(0, 60, 2)] + [(None,), (2,)], "doc_id long")
    got = quality.quality_rules(docs(spark, rows), trusted).collect()
    raw, target = (collections.defaultdict(collections.Counter) for _ in range(2))
    grams = lambda t: (lambda w: [bucket(x) for x in w] + [bucket(a, b) for a, b in zip(w, w[1:])])(WORD.findall(t or ""))
    for f in range(quality.FOLDS):
        for i, t, _ in rows:
            if fold(i) != f:
                raw[f].update(grams(t))
                if i is not None and i < 60 and i % 2 == 0:
                    target[f].update(grams(t))

    def ratio(f, b):
        n, m, size, prior = sum(raw[f].values()), sum(target[f].values()), quality.BUCKETS, quality.PRIOR * quality.BUCKETS
        share = (raw[f][b] + 1) / (n + size)
        return math.log((target[f][b] + prior * share) / (m + prior) / share)

    want = []
    for i, t, _ in rows:
        b, g = base(t), grams(t)
        table = {x: ratio(fold(i), x) for x in set(g)}
        llr = sum(map(table.__getitem__, g)) / len(g) if g else 0.0
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        want.append((i, *b, failed, not failed and llr >= quality.THRESHOLD, round(llr, 9)))
    seen = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, round(r.llr, 9)) for r in got]
    assert sorted(map(str, seen)) == sorted(map(str, want))


def test_quality_without_trust_or_rows(spark, corpus):
    none = spark.createDataFrame([], "doc_id long")
    got = quality.quality_rules(docs(spark, corpus), none).collect()
    assert all(r.llr == 0 and r.kept != r.base_failed for r in got)
    assert quality.quality_rules(docs(spark, []), none).count() == 0


# 2 ------------------------------------------------------------------------------------------------------------------


def test_licenses(spark):
    mit = " ".join(licenses.TEMPLATES["mit"].split())
    draw = random.Random(1)
    long = prose(draw, 30_000)
    rows = [(1, "x. Released under the MIT License. y", "s"), (2, long + " " + mit.replace("sublicense, ", "") + " " + long, "s"), (3, "released later under a license that mit had", "s"), (4, None, "s"), (5, "", "s")]
    rows += [(6, "Licensed under the Apache License, Version 2.0. " * 50, "s"), (7, "All rights reserved. Licensed under CC BY-NC 4.0.", "s"), (1, "x. Released under the MIT License. y", "s"), (8, "the license under released", "s")]
    got = collections.Counter((r.doc_id, r.license, r.licenses) for r in licenses.scan(docs(spark, rows)).collect())
    want = [(1, "mit-line", "mit-line")] * 2 + [(2, "mit", "mit"), (3, None, ""), (4, None, ""), (5, None, ""), (6, "apache-2.0-line", "apache-2.0-line"), (7, "cc-by-nc-4.0-line", "all-rights-reserved,cc-by-nc-4.0-line"), (8, None, "")]
    assert got == collections.Counter(want)


def test_licenses_behind_a_stray_word():
    t = licenses.Template("t", " ".join(f"w{i}" for i in range(100)), 85)
    instance = [f"w{i}" for i in range(100) if i != 10]
    instance[60:60] = ["inserted"] * 25
    for gap in range(0, 120):
        words = ["filler"] * 10 + ["w10"] + ["filler"] * gap + instance + ["filler"] * 60
        places = collections.defaultdict(list)
        for i, w in enumerate(words):
            places[w].append(i)
        assert t.best(words, places) >= 99, gap


def test_alignment_is_a_common_subsequence():
    draw = random.Random(2)
    for _ in range(300):
        a, b = ([draw.choice("abcdefgh") for _ in range(draw.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert licenses.common(a, b) == table[-1][-1]
        assert licenses.aligned(a, b) <= table[-1][-1]
        assert licenses.aligned(a, a) == len(a)


# 3 ------------------------------------------------------------------------------------------------------------------


def tokenizers():
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return path, public_tokenizers.PATTERN, tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokenizer.read_ranks(path), special_tokens={})


def test_bpe(spark, corpus):
    path, pattern, bpe = tokenizers()
    rows = [*corpus, (200, "l'été  \n\n 12345 ñ😀 don't x \r\n\t", "s"), (201, "<|endoftext|>", "s")]
    got = tokenizer.encode(docs(spark, rows), path, pattern, with_ids=True)
    want = []
    for i, t, _ in rows:
        ids = bpe.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:4]) for r in got.collect())
    back = tokenizer.decode(got, path)
    assert collections.Counter(r.text for r in back.collect()) == collections.Counter(t or "" for _, t, _ in rows)


def test_bpe_of_dealt_chunks(spark, monkeypatch):
    path, pattern, bpe = tokenizers()
    for name, value in (("LONG", 150), ("PART", 60), ("OVERLAP", 20)):
        monkeypatch.setattr(tokenizer, name, value)
    draw = random.Random(9)
    rows = [(i, "".join(draw.choice(["a", "Zz", " ", "  ", "\n", "'s", "1", "!?", "é", "x" * 9]) for _ in range(draw.choice([0, 40, 200, 700]))), "s") for i in range(60)]
    rows += [(60, "y" * 500, "s"), (61, "z " + " " * 400 + "w", "s"), (0, rows[0][1], "s"), (62, None, "s")]
    got = tokenizer.encode(docs(spark, rows), path, pattern, with_ids=True).collect()
    want = [(i, np.array(bpe.encode_ordinary(t or ""), "<u4").tobytes(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, bytes(r.ids), r.decoded_sha256)) for r in got)
    assert all(r.ids_sha256 == hashlib.sha256(r.ids).hexdigest() and r.n_tokens == len(r.ids) // 4 for r in got)


def test_stitches():
    import regex

    _, pattern, _ = tokenizers()
    draw, compiled = random.Random(4), regex.compile(pattern)
    for _ in range(400):
        text = "".join(draw.choice(["a", "Zz", " ", "  ", "\n", "'s", "'", "1", "!?", "é", "　", "x" * 40, " " * 30]) for _ in range(draw.randrange(200)))
        got = [p for part in tokenizer.stitched(compiled, text, 24, 12) for p in part]
        assert got == compiled.findall(text)


# 4 ------------------------------------------------------------------------------------------------------------------


def test_urls(spark):
    urls = ["http://A.net/x", "http://a.NET", "https://Example.net/en/1?x", "http://w.example.com/de/2", "http://w.example.com/de", "ftp://q.org/fr/", None, "no url", "http://bad.co.uk/1", "http://bad.co.uk/1", "http://netx/", "://?"]
    pages = spark.createDataFrame([(i, u, "x", "x") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    outcomes = spark.createDataFrame([(8, 1)] * 60 + [(3, 0)] * 900 + [(5, 0), (None, 1), (4, None)], "page_id long, bad int")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.url_filter(pages, outcomes).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block") and got[1] == ("a.net", "", None, "allow")
    assert got[2] == ("example.net", "/en/1", "example.net/en/", "allow") and got[3][2:] == ("example.com/de/", "block")
    assert got[4][2:] == (None, "allow") and got[5][2:] == ("org/fr/", "allow")
    assert got[6] == got[7] == ("", "", None, "allow") and got[8][2:] == got[9][2:] == (None, "block")
    assert got[10][:3] == ("netx", "/", None) and got[11][:2] == ("", "")
    assert len(got) == len(urls)
    empty = url_filter.url_filter(pages, outcomes.limit(0)).collect()
    assert {r.verdict for r in empty if r.rule is None} == {"allow"}


# 5 ------------------------------------------------------------------------------------------------------------------


def test_forward_is_exact():
    draw = np.random.default_rng(1)
    k, n = 3, 7
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    model = lm.Model(norm(draw.random(k), 0), norm(draw.random(k), 0), norm(draw.random((k, k)), 1), norm(draw.random((n, k)), 0))
    seqs = [draw.integers(0, n, m).astype(np.int32) for m in (1, 5, 2, 5)]
    got = lm.log_likelihoods(model, seqs)
    for s, g in zip(seqs, got):
        total = 0.0
        for path in np.ndindex(*([k] * len(s))):
            p = model.pi[path[0]] * model.e[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.a[path[t - 1], path[t]] * model.e[s[t], path[t]]
            total += p
        assert math.isclose(g, math.log10(total), abs_tol=1e-9)


def test_lm(spark, corpus):
    rows = [*corpus, (300, "Never SEEN words", "s"), (301, "W1 w2", "s")]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    small = dict(states=3, own_classes=40, looked_up=60)
    got = lm.lm_score(docs(spark, rows), ~(lm.remainder("doc_id", 7) == 2), **small).collect()
    words = lambda t: (t or "").encode().lower().split()
    c, n_docs = collections.Counter(), 0
    for i, t, _ in rows:
        if not held(i):
            c.update(words(t))
            n_docs += 1
    n, v = sum(c.values()) + n_docs, len(c) + 1
    want = []
    for i, t, _ in rows:
        own = words(t)
        score = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own) + math.log10((n_docs + 1) / (n + v + 1))
        want.append((i, len(own) + 1, sum(w in c for w in own) + 1, n, round(score, 6)))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))) for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_lm_sums_to_one(spark):
    """Over all texts of one known word or none, what is left is for longer and unknown ones."""
    rows = [(i, t, "s") for i, t in enumerate(["a", "b a", "a b", "", "c"] * 3)]
    probes = [(100 + i, t, "s") for i, t in enumerate(["", "a", "b", "c", "a a", "a b", "zz"])]
    got = lm.lm_score(docs(spark, rows + probes), F.col("doc_id") < 100, states=2, own_classes=2, looked_up=2).where("doc_id >= 100").collect()
    assert 0.3 < sum(10**r.score for r in got) <= 1


# 6 ------------------------------------------------------------------------------------------------------------------


def components(rows):
    sets = []
    for _, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                label[find(i)] = find(j)
    least = {}
    for i, (k, _, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return collections.Counter((k, len(sets[i]), least.get(find(i))) for i, (k, _, _) in enumerate(rows))


def family(n):
    draw, base = random.Random(5), [f"w{k}" for k in range(80)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(draw.choice([0, 1, 1, 2, 3])):
            w[draw.randrange(len(w))] = f"x{draw.randrange(900)}"
        rows.append((1000 + i, " ".join(w), "s"))
    return rows


def test_jaccard(spark, corpus, monkeypatch):
    rows = [*corpus, *family(120), (400, "A  b", "s"), (401, "a B", "s"), (402, "one", "s")]
    for block, small in ((512, 64), (16, 8)):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "SMALL", small)
        got = jaccard.jaccard_components(docs(spark, rows).repartition(5))
        assert collections.Counter(map(tuple, got.collect())) == components(rows)
    assert jaccard.jaccard_components(docs(spark, [])).count() == 0


# 7 ------------------------------------------------------------------------------------------------------------------


def test_toxicity(spark):
    draw = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        group = i % 3 == 0 or bad and i % 2 == 0
        text = prose(draw, 40) + ((" Awful!" if i % 10 else " scum!") if bad else "") + (" the muslim women" if group else "")
        rows.append((i, text, "s"))
        labels.append((i, int(bad)))
    frame, known = docs(spark, rows), spark.createDataFrame(labels + [(None, 1), (3, None), (0, 0)], "doc_id long, toxic int")
    model = toxicity.train(frame, known.where(~toxicity.held_out("doc_id")))
    probes = docs(spark, [(1, "you are scum", "s"), (2, "the muslim women came", "s"), (3, None, "s"), (4, "", "s"), (1, "you are scum", "s")])
    got = sorted((r.doc_id, r.predicted, 0 <= r.score <= 1) for r in toxicity.toxicity(probes, model).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 0, True), (3, 0, True), (4, 0, True)]
    truth = dict(labels)
    unseen = toxicity.toxicity(frame.where(toxicity.held_out("doc_id")), model).collect()
    assert sum(r.predicted == truth[r.doc_id] for r in unseen) >= 0.95 * len(unseen)
    assert toxicity.toxicity(probes, toxicity.train(frame, known.limit(0))).where("predicted = 1").count() == 0


def test_swaps_hold_identity_terms_down():
    rows = [["muslim", "awful"] if i % 2 else ["calm"] for i in range(200)] + [["christian", "calm"]] * 20
    toxic = np.array([float(i % 2) for i in range(200)] + [0.0] * 20)
    words = ["awful", "calm", "christian", "muslim"]
    free, held = (toxicity.fitted(words, rows, toxic, p) for p in (0.0, 5.0))
    gap = lambda m: abs(m.weight["muslim"] - m.weight["christian"])
    assert gap(held) < 0.5 * gap(free) and held.score("awful") > 0.7


# 8 ------------------------------------------------------------------------------------------------------------------


def test_embeddings(spark, monkeypatch):
    draw = np.random.default_rng(8)
    centre = draw.standard_normal((12, 16))
    vecs = [(c + 0.15 * draw.standard_normal(16)).astype(np.float32).tolist() for c in centre for _ in range(9)]
    vecs += [vecs[0], vecs[0], [0.0] * 16, [], None, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    vecs += draw.standard_normal((40, 16)).astype(np.float32).tolist()
    rows = [(i, v, 0, True) for i, v in enumerate(vecs)]
    monkeypatch.setattr(embedding, "BLOCK", 8)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, kept boolean")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding.near_dedup(frame).collect()}
    good = [i for i, v in enumerate(vecs) if v and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([vecs[i] for i in good], float)
    near = embedding.cosines(x, x) >= 0.9
    label = np.arange(len(good))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(good))])
        if (new == label).all():
            break
        label = new
    want = {i: (0, i, True) for i in range(len(vecs))}
    want |= {i: (int(near[j].sum()) - 1, good[label[j]], good[label[j]] == i) for j, i in enumerate(good)}
    assert got == want
    assert embedding.near_dedup(frame.limit(0)).count() == 0


def unlike(draw, x, cosine):
    """A vector at that cosine from x."""
    y = draw.standard_normal(len(x))
    x = x / np.linalg.norm(x)
    y -= (y @ x) * x
    return cosine * x + math.sqrt(1 - cosine**2) * y / np.linalg.norm(y)


def test_embeddings_across_full_lists(spark):
    draw = np.random.default_rng(5)
    one = draw.standard_normal(64)
    two = unlike(draw, one, 0.925)
    vecs = [unlike(draw, c, 0.998) for c in (one, two) for _ in range(40)]
    x = np.array(vecs)
    near = embedding.cosines(x, x) >= 0.9
    assert near.all() and embedding.cosines(x[:40], x[:40]).min() > 0.992 > embedding.cosines(x[:40], x[40:]).max()
    vecs += list(draw.standard_normal((60, 64)))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding.near_dedup(frame).collect()}
    assert got == {i: (79, 0) if i < 80 else (0, i) for i in range(140)}


@pytest.mark.parametrize("small", [0, embedding.SMALL if hasattr(embedding, "SMALL") else 0])
def test_embeddings_pairs_beside_a_large_group(spark, monkeypatch, small):
    monkeypatch.setattr(embedding, "SMALL", small, raising=False)
    draw = np.random.default_rng(6)
    centre = draw.standard_normal(64)
    vecs = [unlike(draw, centre, 0.98) for _ in range(1000)]
    for x in draw.standard_normal((1000, 64)):
        vecs += [x, unlike(draw, x, 0.92)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.component_id for r in embedding.near_dedup(frame).collect()}
    assert {got[i] for i in range(1000)} == {0}
    assert sum(got[i + 1] == i for i in range(1000, 3000, 2)) >= (1000 if small else 985)


# 9 ------------------------------------------------------------------------------------------------------------------


def test_mixing(spark, corpus):
    frame = docs(spark, corpus)
    got = mixing.mix(frame).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(frame.repartition(7)).collect()))
    sizes = collections.Counter()
    for _, t, s in corpus:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, full, target = sum(sizes.values()), set(), {}
    while True:
        open_ = [s for s in order if s not in full]
        level = (left - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in open_)
        more = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not more:
            break
        full |= more
    target = {s: 3 * sizes[s] if s in full else level * weight[s] for s in order}
    taken, by_size = collections.Counter(), {(sizes[s]): s for s in order}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[by_size[r.source_size]] += r.taken
        assert math.isclose(r.target, target[by_size[r.source_size]], rel_tol=1e-12)
    assert all(taken[s] == math.floor(target[s]) for s in order)
    assert mixing.mix(docs(spark, [])).count() == 0


# 10 -----------------------------------------------------------------------------------------------------------------


def test_lines(spark, corpus):
    rows = [(i, t, s) for i, t, s in corpus]
    got = line_dedup.line_dedup(docs(spark, rows), F.col("source")).collect()
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    floor = {r.doc_id: r.text for r in line_dedup.line_dedup(docs(spark, rows), F.col("source"), min_pages=10**6).collect()}
    assert floor == {i: t for i, t, _ in rows}
    pages, seen = collections.Counter(s for _, _, s in rows), collections.Counter()
    for _, t, s in rows:
        seen.update({(s, strip(x)) for x in (t or "").split("\n") if strip(x)})
    want = []
    for i, t, s in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if not (strip(x) and seen[s, strip(x)] > 1 and 100 * seen[s, strip(x)] > 30 * pages[s])]
        want.append((i, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.text, r.n_lines, r.n_dropped)) for r in got)
    assert any(w[3] for w in want) and line_dedup.line_dedup(docs(spark, []), F.col("source")).count() == 0


# pipeline -----------------------------------------------------------------------------------------------------------


def test_pipeline(spark, corpus, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    path, pattern, bpe = tokenizers()
    rows = [*corpus, *family(12)]
    frame = docs(spark, rows).drop("kept", "n_words").withColumn("size", F.lit("mine"))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, str(tmp_path))
        assert now.columns == frame.columns, name
        now = spark.read.parquet(write(now, f"{tmp_path}/{name}"))
        if name.startswith("n-gram"):
            found = components([(r.doc_id, r.text, r.source) for r in before.collect()])
            heads = {c for _, n, c in found if n and c is not None}
            assert {r.doc_id for r in now.where("trim(text) <> ''").collect()} >= heads and now.count() <= before.count()
        if name.startswith("mixing"):
            words = lambda d: sum(len(WORD.findall(r.text or "")) for r in d.collect())
            assert abs(words(now) - words(before)) <= 5
    last = pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.n_tokens) for r in last) == collections.Counter((r.doc_id, len(bpe.encode_ordinary(r.text or ""))) for r in now.collect())


def test_pipeline_drops_shared_passages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    draw = random.Random(7)
    rows = [(i, prose(draw, 60) + f" own{i}" + ("\nOn a fifth of them." if i % 5 == 0 else "") + ("\nOn a tenth of them." if i % 10 == 1 else ""), "s") for i in range(40)]
    got = {r.doc_id: r.text for r in pipeline.line_dedup_stage(spark, docs(spark, rows), "").collect()}
    assert got == {i: t.replace("\nOn a fifth of them.", "") for i, t, _ in rows}


def test_pipeline_joins_near_copies_on_five_words(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    words = [f"v{i}" for i in range(100)]
    near, far = list(words), list(words)
    for i in (20, 50):
        near[i] = f"x{i}"
    for i in (20, 50, 80):
        far[i] = f"y{i}"

    def share(a, b, n):
        a, b = ({tuple(x[i : i + n]) for i in range(len(x) - n + 1)} for x in (a, b))
        return len(a & b) / len(a | b)

    assert share(words, near, 5) >= 0.8 > share(words, far, 5) and share(words, near, 4) < 0.85 and share(near, far, 5) < 0.8
    rows = [(i, " ".join(x), "s") for i, x in enumerate((words, near, far))]
    assert sorted(r.doc_id for r in pipeline.jaccard_join(spark, docs(spark, rows), "").collect()) == [0, 2]


def write(df, path):
    df.write.parquet(path)
    return path
