"""Empty tables, nulls, repeated ids, clashing names, bounds, and the operators against second versions of their parts."""

import collections
import json
import math
import random
import types

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tesserae.llm import common, embedding, graph, jaccard, licenses, line_dedup, lm, mixing, quality, queries, tokenizer, toxicity, url_filter
from tests.llm.test_llm import docs, prose, tokenizers, unlike

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, source string, row string, host string, lines string, left string, marks string, words string, grams string, fold string, ratios string, _host string, _words string"


def odd(spark, rows):
    """Rows with columns whose names operators could use for themselves."""
    return spark.createDataFrame([(*r, *["own"] * 11) for r in rows], ODD)


# shared helpers -----------------------------------------------------------------------------------------------------


def test_sieve_loses_nothing(spark):
    rows = spark.range(20_000).select((F.col("id") * 7).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("b"))
    wanted = rows.where("a % 70 = 0")
    met = common.sieve(rows, wanted, ["a", "b"])
    assert met.columns == ["a", "b", "_maybe"] and met.count() == 20_000
    kept = met.where("_maybe")
    assert kept.where("a % 70 = 0").count() == 2_000 and kept.count() < 2_200
    assert common.sieve(rows, wanted.limit(0), ["a", "b"]).where("_maybe").count() == 0


def test_a_cluster_must_name_its_folder():
    unset = types.SimpleNamespace(get=lambda *_: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.stage_root(types.SimpleNamespace(conf=unset, sparkContext=types.SimpleNamespace(master="spark://host:7077")))


# empty tables -------------------------------------------------------------------------------------------------------


def test_empty_tables(spark):
    none, labels = docs(spark, []), spark.createDataFrame([], "doc_id long, toxic int")
    path, pattern, _ = tokenizers()
    assert licenses.scan(none).count() == 0
    assert tokenizer.encode(none, path, pattern).count() == 0
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, bad int")).count() == 0
    assert lm.lm_score(none, F.lit(True), states=2, own_classes=2, looked_up=2).count() == 0
    assert toxicity.toxicity(none, toxicity.train(none, labels)).count() == 0


def test_pipeline_of_empty_and_odd_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    none = odd(spark, [])
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name
    draw = random.Random(2)
    text = prose(draw, 80)
    rows = [(1, text, "s"), (1, text, "s"), (None, text, None), (None, text, None), (2, None, "s"), (None, None, None), (3, "", "s"), (4, prose(draw, 5000), None)]
    frame = odd(spark, rows)
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, frame, str(tmp_path))
        assert got.columns == frame.columns, name
        assert {x for r in got.collect() for x in r[3:]} == {"own"}, name
    left = [(r.doc_id, r.text) for r in pipeline.jaccard_join(spark, frame, "").collect()]
    assert sorted(map(str, left)) == sorted(map(str, [(1, text), (2, None), (None, None), (3, ""), (4, rows[-1][1])]))
    assert pipeline.STAGES[-1][1](spark, frame, "").count() == len(rows)


def test_names_of_other_columns(spark):
    draw = random.Random(2)
    rows = [(i, prose(draw, 60) + "\nOn all of them.", "s") for i in range(6)] + [(7, None, None)]
    frame = odd(spark, rows)
    lines = line_dedup.line_dedup(frame, F.col("source"))
    assert lines.columns == [*frame.columns, "n_lines", "n_dropped"]
    judged = quality.quality_rules(frame, spark.createDataFrame([(1,)], "doc_id long"))
    assert judged.columns == [*frame.columns, *quality.MEASURES, "base_failed", "llr", "kept"]
    for got in (lines, judged):
        assert {x for r in got.collect() for x in r[3 : len(frame.columns)]} == {"own"}
    assert {r.n_dropped for r in lines.where("text IS NOT NULL").collect()} == {1}


# 2 ------------------------------------------------------------------------------------------------------------------


def patience(a, b):
    """The alignment by its definition, recursively; of longest increasing sequences, the one whose places in b are least
    from its end on."""
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    if k:
        return k + patience(a[k:], b[k:])
    if a and b and a[-1] == b[-1]:
        return 1 + patience(a[:-1], b[:-1])
    anchors = [(i, b.index(w)) for i, w in enumerate(a) if a.count(w) == 1 and b.count(w) == 1]
    if not anchors:
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]
    best = []
    for n, (_, y) in enumerate(anchors):
        ends = [s for s in best if s[-1][1] < y]
        longest = max(map(len, ends), default=0)
        best.append(min((s for s in ends if len(s) == longest), key=lambda s: s[-1][1], default=[]) + [anchors[n]])
    longest = max(map(len, best))
    chosen = min((s for s in best if len(s) == longest), key=lambda s: s[-1][1])
    total, i, j = len(chosen), 0, 0
    for x, y in [*chosen, (len(a), len(b))]:
        total += patience(a[i:x], b[j:y])
        i, j = x + 1, y + 1
    return total


def test_patience_by_its_definition():
    draw = random.Random(12)
    for n in range(600):
        letters = "abcdefghijklmnopqrstuvwxyz"[: draw.choice([3, 8, 26])]
        a, b = ([draw.choice(letters) for _ in range(draw.randrange(25))] for _ in range(2))
        if n % 2:
            b = [w for w in a if draw.random() < 0.8]
            for _ in range(draw.randrange(4)):
                b.insert(draw.randrange(len(b) + 1), draw.choice(letters))
        assert licenses.aligned(a, b) == patience(a, b), (a, b)


def test_scan_of_whole_licenses():
    draw, known = random.Random(3), [licenses.Template(k, v, 85) for k, v in licenses.TEMPLATES.items()]
    for t in known:
        for drop in (0.0, 0.08, 0.4):
            body = [w for w in t.words if drop == 0 or draw.random() >= drop]
            words = [f"w{draw.randrange(50)}" for _ in range(300)] + body + [f"w{draw.randrange(50)}" for _ in range(300)]
            places = collections.defaultdict(list)
            for i, w in enumerate(words):
                places[w].append(i)
            got, whole = t.best(words, places), patience(words, t.words) if len(t.words) < 20 else len(body)
            assert got == (whole if whole >= t.needed else 0) or (got >= t.needed and got >= whole), (t.name, drop)


def test_templates_from_a_folder(spark, tmp_path):
    (tmp_path / "mine.txt").write_text("You may use this thing on Sundays only, and never twice.")
    rows = [(1, "so: you may use this thing on Sundays only, and never twice!", "s"), (2, "you may use it", "s")]
    got = {r.doc_id: r.license for r in licenses.scan(docs(spark, rows), templates=licenses.read_templates(str(tmp_path))).collect()}
    assert got == {1: "mine", 2: None}


# 3 ------------------------------------------------------------------------------------------------------------------


def test_bpe_of_all_documents(spark):
    path, pattern, bpe = tokenizers()
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: bytes(r.ids) for r in tokenizer.encode(frame, path, pattern, with_ids=True).collect()}
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert sum(len(x["text"] or "") > tokenizer.CHUNK + tokenizer.OVERLAP for x in texts) > 50
    assert got == {x["doc_id"]: np.array(bpe.encode_ordinary(x["text"] or ""), "<u4").tobytes() for x in texts}


def test_merges():
    path, _, bpe = tokenizers()
    ranks, draw = tokenizer.read_ranks(path), random.Random(5)
    longest = max(map(len, ranks))
    for _ in range(500):
        piece = "".join(draw.choice(["a", "th", "e", "é", "😀", "ing", "x", "xx", "0"]) for _ in range(1 + draw.randrange(40)))
        want = bpe._encode_single_piece(piece.encode())
        assert tokenizer.merged(piece.encode(), ranks, longest) == want
        assert len(piece) < 3 or piece.encode() in ranks or tokenizer.merged_by_heap(piece.encode(), ranks, longest) == want


# 4 ------------------------------------------------------------------------------------------------------------------


def test_repeated_pages_count_as_they_stand(spark):
    rows = [(1, "http://a.example/x", "c")] * 3 + [(2, "http://b.example/x", "c"), (None, "http://b.example/y", "c"), (None, None, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, n string")
    # As the query makes them: an outcome for each row of a labelled page.
    outcomes = spark.createDataFrame([(1, 1)] * 3 + [(2, 0), (2, 1), (2, None), (None, 1), (7, 1)], "page_id long, bad int")
    got = {r.host: (r.n, r.k) for r in url_filter.reputation(pages, outcomes).collect()}
    assert got == {"a.example": (3, 3), "b.example": (2, 1), "": (0, 0)}
    assert url_filter.url_filter(pages, outcomes).count() == 6 and url_filter.url_filter(pages.limit(0), outcomes).count() == 0


def test_reputation_by_hand(spark):
    draw, rows, bad = random.Random(8), [], []
    for i in range(300):
        host = draw.choice(["a.x.com", "b.x.com", "y.com", "z.co.uk", "w.z.co.uk", "q.org"])
        rows.append((i, f"http://{host}/{i}"))
        if draw.random() < 0.7:
            bad.append((i, int(draw.random() < {"a": 0.8, "b": 0.2, "y": 0.1, "z": 0.5, "w": 0.6, "q": 0.0}[host[0]])))
    got = {r.host: (r.rate, r.lower) for r in url_filter.reputation(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, bad int")).collect()}
    of = {i: u.split("/")[2] for i, u in rows}
    parent = {"a.x.com": "x.com", "b.x.com": "x.com", "y.com": "y.com", "z.co.uk": "z.co.uk", "w.z.co.uk": "z.co.uk", "q.org": "q.org", "x.com": "com", "z": "co.uk"}
    suffix = {"x.com": "com", "y.com": "com", "z.co.uk": "co.uk", "q.org": "org"}
    levels = [{h: suffix[parent[h]] for h in set(of.values())}, {h: parent[h] for h in set(of.values())}, {h: h for h in set(of.values())}]
    rate = {None: sum(x for _, x in bad) / len(bad)}
    above = lambda depth, h: rate[None] if depth == 0 else rate[depth - 1, levels[depth - 1][h]]
    for depth, name in enumerate(levels):
        tally = collections.defaultdict(lambda: [0, 0, 0.0])
        for h in name:
            tally[name[h]][2] = above(depth, h)
        for i, x in bad:
            t = tally[name[of[i]]]
            t[0], t[1] = t[0] + 1, t[1] + x
        extra = sum((k - n * mu) ** 2 - n * mu * (1 - mu) for n, k, mu in tally.values())
        rho = extra / sum(n * (n - 1) * mu * (1 - mu) for n, k, mu in tally.values())
        m = min(max(1 / rho - 1, 1.0), 1000.0) if rho > 0 else 1000.0
        for who, (n, k, mu) in tally.items():
            rate[depth, who] = (k + m * mu) / (n + m)
    for h, (q, lower) in got.items():
        n = sum(of[i] == h for i, _ in bad)
        assert math.isclose(q, rate[2, h], rel_tol=1e-9)
        assert math.isclose(lower, q - url_filter.Z * math.sqrt(q * (1 - q) / (n + m + 1)), rel_tol=1e-9)


# 5 ------------------------------------------------------------------------------------------------------------------


def test_expected_counts_over_all_paths():
    draw = np.random.default_rng(4)
    k, n = 2, 4
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    model = lm.Model(norm(draw.random(k), 0), norm(draw.random(k), 0), norm(draw.random((k, k)), 1), norm(draw.random((n, k)), 0))
    seqs, first = [draw.integers(0, n, m).astype(np.uint16) for m in (1, 6, 3, 6, 2)], np.array([True, True, False, False, True])
    got = np.zeros(k), np.zeros((k, k)), np.zeros((n, k))
    loglik = lm.expected(model, seqs, first, got)
    want, total = (np.zeros(k), np.zeros((k, k)), np.zeros((n, k))), 0.0
    for s, begins in zip(seqs, first):
        begin = model.pi if begins else model.occ
        weight = {}
        for path in np.ndindex(*([k] * len(s))):
            p = begin[path[0]] * model.e[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.a[path[t - 1], path[t]] * model.e[s[t], path[t]]
            weight[path] = p
        all_ = sum(weight.values())
        total += math.log(all_)
        for path, p in weight.items():
            if begins:
                want[0][path[0]] += p / all_
            for t, state in enumerate(path):
                want[2][s[t], state] += p / all_
                if t:
                    want[1][path[t - 1], state] += p / all_
    for g, w in zip(got, want):
        assert np.allclose(g, w, rtol=1e-4, atol=1e-5)
    assert math.isclose(loglik, total, rel_tol=1e-5)


def test_training_climbs_over_all_texts(spark):
    draw = random.Random(3)
    ids = [np.array([draw.randrange(6) + 6 * (i % 2) for _ in range(40)] + [12], "<u2").tobytes() for i in range(60)]
    frame = spark.createDataFrame([(bytearray(x),) for x in ids], "ids binary").repartition(3)
    _, curve = lm.trained(frame, np.full(13, 1 / 13), 2, most=30, settled=1e-4)
    assert all(b >= a - 1e-3 * abs(a) for a, b in zip(curve, curve[1:])) and curve[-1] > 0.85 * curve[0] > curve[0]
    assert len(curve) < 30


def test_lm_of_repeated_ids(spark):
    draw = random.Random(5)
    rows = [(1, None, "s"), (1, prose(draw, 30), "s"), (1, prose(draw, 30_000), "s"), (None, None, "s"), (None, "w1 w2", "s"), (2, "", "s"), (2, "x" * 200 + " w1", "s")]
    got = lm.lm_score(docs(spark, rows), F.lit(True), states=2, own_classes=20, looked_up=30).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 1, 3, 3, 31, 30_001]
    assert all(math.isfinite(r.score) and r.n_known == r.n_tokens for r in got)


# 6 ------------------------------------------------------------------------------------------------------------------


def test_jaccard_of_rows_without_ids(spark, monkeypatch):
    words, rows = [f"v{i}" for i in range(60)], []
    for i in range(200):
        w = list(words)
        w[30] = f"x{i}"
        rows.append((None, " ".join(w), "s"))
    rows += [(None, rows[0][1], "s")] * 50 + [(7, rows[1][1], "s")] * 50
    counts, plain = {}, jaccard.staged

    def staged(df, name):
        out = plain(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "staged", staged)
    got = jaccard.jaccard_groups(docs(spark, rows), percent=80).collect()
    assert counts["texts"] <= 200
    assert {r.component_id for r in got} == {7} and sum(r.head for r in got) == 1 and len(got) == len(rows)


def test_jaccard_of_frequent_and_chance_ngrams(spark, monkeypatch):
    from tests.llm.test_llm import components

    monkeypatch.setattr(jaccard, "SMALL", 6)
    monkeypatch.setattr(jaccard, "CLOSE", 3)
    draw, rows = random.Random(9), []
    stock = [prose(draw, draw.choice([6, 12, 30])) for _ in range(12)]
    for i in range(160):
        parts = [draw.choice(stock) for _ in range(draw.choice([1, 2, 3]))]
        if draw.random() < 0.4:
            parts.insert(draw.randrange(len(parts) + 1), prose(draw, draw.choice([1, 3, 20])))
        rows.append((i, " ".join(parts), "s"))
    got = jaccard.jaccard_components(docs(spark, rows).repartition(3))
    assert collections.Counter(map(tuple, got.collect())) == components(rows)


def test_jaccard_of_large_groups_that_share_a_passage(spark, monkeypatch):
    from tests.llm.test_llm import components

    draw, passage = random.Random(11), [f"p{i}" for i in range(30)]
    rows = []
    for g in range(5):
        base = passage + [f"g{g}w{i}" for i in range(60)]
        for _ in range(40):
            w = list(base)
            for _ in range(draw.choice([0, 1, 1, 2])):
                w[draw.randrange(30, len(w))] = f"x{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(w), "s"))
    for w in ([f"g0w{i}" for i in range(60)], passage + [f"g1w{i}" for i in range(58)] + ["end", "of"]):
        rows.append((len(rows), " ".join(w), "s"))
    for name, value in (("SMALL", 4), ("BLOCK", 12)):
        monkeypatch.setattr(jaccard, name, value)
    got = jaccard.jaccard_components(docs(spark, rows).repartition(3))
    assert collections.Counter(map(tuple, got.collect())) == components(rows)


def test_components_and_jaccard_broadcast_no_table_of_nodes(spark, monkeypatch):
    plans, plain = {}, graph.staged

    def staged(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(graph, "staged", staged)
    monkeypatch.setattr(jaccard, "staged", staged)
    edges = spark.createDataFrame([(i, i + 1) for i in range(30) if i % 4], "a long, b long")
    assert {(r.node, r.label) for r in graph.components(edges).collect()} == {(i, i - (i - 1) % 4) for i in range(1, 31)}
    assert len(plans["labels"]) > 2 and not any("BroadcastHashJoin" in p for p in plans["labels"])
    rows = [(i, " ".join(f"g{i % 20}w{j}" for j in range(60)) + f" x{i}", "s") for i in range(60)]
    got = jaccard.jaccard_groups(docs(spark, rows))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(i, i % 20) for i in range(60)}
    assert not any("BroadcastHashJoin" in p for p in plans["families"] + plans["wanted"])
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


# 7 ------------------------------------------------------------------------------------------------------------------


def test_gradient():
    draw = np.random.default_rng(2)
    words = ["awful", "calm", "muslim", "christian", "hindu", "women", "men"]
    rows = [[w for w in words if draw.random() < 0.4] for _ in range(30)]
    loss = toxicity.Loss(words, rows, draw.integers(0, 2, 30).astype(float), 0.7)
    w, b, step = draw.standard_normal(len(words)), 0.3, 1e-6
    _, got = loss.of(w, b)
    for i in range(len(words) + 1):
        off = np.eye(len(words) + 1)[i] * step
        up, down = (loss.of(w + s * off[:-1], b + s * off[-1])[0] for s in (1, -1))
        assert math.isclose(got[i], (up - down) / (2 * step), rel_tol=1e-5, abs_tol=1e-8)
    # The penalty by its definition: a text's logit before and after its terms are swapped.
    weight = dict(zip(words, w))
    logit = lambda own: sum(weight.get(x, 0.0) for x in own)
    naming = [set(r) for r in rows if toxicity.SWAP.keys() & set(r)]
    want = 0.7 * sum((logit(toxicity.swapped(r)) - logit(r)) ** 2 for r in naming) / len(naming)
    assert math.isclose(loss.of(w, b)[0] - toxicity.Loss(words, rows, loss.toxic, 0.0).of(w, b)[0], want, rel_tol=1e-9)


def test_labelled_rows_are_bounded(spark, monkeypatch):
    frame = docs(spark, [(1, f"text {i}", "s") for i in range(300)] + [(2, "text", "s")] * 300)
    seen = {}
    monkeypatch.setattr(toxicity, "staged", lambda df, name: seen.setdefault(name, common.staged(df, name)))
    toxicity.train(frame, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), sample=50)
    assert seen["labelled"].count() <= 50


# 8 ------------------------------------------------------------------------------------------------------------------


def test_embeddings_of_any_size(spark):
    draw = np.random.default_rng(3)
    one, two = draw.standard_normal(16), draw.standard_normal(16)
    vecs = [one * 1e200, one * 3e100, one * 1e-200, unlike(draw, one, 0.95) * 1e150, two * 1e300, two, draw.standard_normal(16)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding.near_dedup(frame).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (1, 4), 5: (1, 4), 6: (0, 6)}


def test_embeddings_where_the_audit_never_passes(spark, monkeypatch):
    for name, value in (("SMALL", 0), ("MOST", 3), ("RECALL", 1.1)):
        monkeypatch.setattr(embedding, name, value)
    draw = np.random.default_rng(7)
    vecs = []
    for x in draw.standard_normal((300, 64)):
        vecs += [x, unlike(draw, x, 0.91)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding.near_dedup(frame).collect()}
    assert got == {i: (1, i - i % 2) for i in range(600)}


def test_embeddings_of_small_tables_get_rounds_too(spark, monkeypatch):
    monkeypatch.setattr(embedding, "ORDERS", 1)
    said, compared, passed, joined = [], [], embedding.Audit.passed, embedding.joined_exactly
    monkeypatch.setattr(embedding.Audit, "passed", lambda self, labelled: said.append(passed(self, labelled)) or said[-1])
    monkeypatch.setattr(embedding, "joined_exactly", lambda rows, width: compared.append(rows.count()) or joined(rows, width))
    draw = np.random.default_rng(12)
    vecs = []
    for x in draw.standard_normal((300, 64)):
        vecs += [x, unlike(draw, x, 0.93)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding.near_dedup(frame).collect()}
    assert got == {i: (1, i - i % 2) for i in range(600)}
    assert said[0] is False and said[-1] is True and not any(compared)


# SQL ----------------------------------------------------------------------------------------------------------------


def test_queries_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "documents embeddings pages labels".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, SF)
        columns = sorted(got.columns)
        rows = [tuple(r[c] for c in columns) for r in got.collect()]
        want = con.sql(f"select {', '.join(json.dumps(c) for c in columns)} from ({sql})").fetchall()
        assert sorted(map(str, rows)) == sorted(map(str, want)), name


def test_mixing_of_rows_without_ids(spark):
    draw = random.Random(4)
    rows = [(None, prose(draw, 20), "a") for _ in range(40)] + [(i, prose(draw, 10), "b") for i in range(20)]
    got = mixing.mix(docs(spark, rows)).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs(spark, rows[::-1]).repartition(5)).collect()))
    assert mixing.mix(docs(spark, rows).select("doc_id", "source", "n_chars"), size=F.col("n_chars")).count() == 60


def test_the_mixing_stage_puts_out_what_was_drawn(spark):
    from corpus_pipeline import mixing as stage

    # Ids and sizes that are alike; rows that are alike in all; a source whose budget is cut within rows that are alike.
    rows = [(1, "q r s t u v", "s1", 11), (1, "k l m n o p", "s1", 11), (None, "a b", "s2", 3), (None, "a b", "s2", 3), (None, "a b", "s2", 3), (None, "a b", None, 3), (2, None, "s1", 0), (3, "", "s2", 0)]
    rows += [(9, "x y z", "s3", 5)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    drawn = mixing.mix(docs, with_draw=True).where("taken > 0").collect()
    texts = {r.draw: None for r in drawn}
    for r in docs.select("text", mixing.draw_of(F.col("doc_id"), F.col("text")).alias("draw")).collect():
        if r.draw in texts:
            texts[r.draw] = r.text
    expected = []
    for r in drawn:
        words = texts[r.draw].split()
        for at in range(0, r.taken, r.size):
            expected.append((r.doc_id, r.source, " ".join(words[: min(r.size, r.taken - at)])))
    got = stage(spark, docs, "").collect()
    assert sorted(map(str, ((r.doc_id, r.source, r.text) for r in got))) == sorted(map(str, expected))
    assert all(r.n_chars == len(r.text) for r in got) and stage(spark, docs.limit(0), "").count() == 0


def test_stitches_of_runs_are_linear():
    import time

    import public_tokenizers
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    r = random.Random(4)
    runs = ["x" * 8_000_000, "=" * 3_000_000, " " * 2_000_000 + "a", ("y" * 20_000 + " ") * 50]
    for text in runs:
        began = time.process_time()
        whole = pattern.findall(text)
        plain = time.process_time() - began
        began = time.process_time()
        got = [p for pieces in tokenizer.stitched(pattern, text) for p in pieces]
        took = time.process_time() - began
        assert got == whole and took < 2 + 4 * plain
    for _ in range(300):
        text = "".join(r.choice(["a" * r.randrange(1, 90), " " * r.randrange(1, 40), "\n" * r.randrange(1, 9), "don't ", "1234567 ", "==" * r.randrange(1, 30), "é日本 "]) for _ in range(r.randrange(1, 40)))
        for chunk, overlap in ((16, 4), (40, 16), (7, 1)):
            assert [p for pieces in tokenizer.stitched(pattern, text, chunk, overlap) for p in pieces] == pattern.findall(text)
