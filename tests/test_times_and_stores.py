"""Joins by time, incremental profiles and predicates from text, against brute force and on the cases of their docstrings."""

import collections
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tesserae.operators import predicates, profile, related, sketches, times
from tesserae.operators.incremental import ProfileStore
from tesserae.schema import Facet, FacetSchema

START = datetime(2024, 1, 1)
TWO = FacetSchema((Facet("source_id", True), Facet("realm", True), Facet("kind")))
DDL = "source_id array<string>, realm array<string>, kind string"


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_as_of_against_brute_force(spark):
    r = random.Random(9)
    moment = lambda: None if r.random() < 0.05 else START + timedelta(minutes=r.randrange(60 * 24 * 12))
    # Most rows have one key, and times are often the same.
    left = [(i, r.choice([1, 1, 1, 2, 3, None]), moment(), "own") for i in range(400)]
    right = [(r.choice([1, 1, 1, 2, None]), moment(), i, f"v{i}" if i % 5 else None) for i in range(300)]
    left += [(900 + i, 1, right[i][1], "own") for i in range(20)] + [left[0]]
    a = spark.createDataFrame(left, "id long, k long, t timestamp_ntz, c0 string")
    b = spark.createDataFrame(right, "key long, at timestamp_ntz, n long, v string")
    got = times.as_of(a, b, ("k", "key"), ("t", "at"), ["n", "v"], ["n"], stretch_s=3600 * 30)
    assert got.columns == ["id", "k", "t", "c0", "n", "v"] and "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    expected = []
    for i, k, t, c in left:
        before = [x for x in right if k is not None and t is not None and x[0] == k and x[1] is not None and x[1] <= t]
        latest = max(before, key=lambda x: (x[1], x[2]), default=None)
        expected.append((i, k, t, c, *(latest[2:] if latest else (None, None))))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))
    assert times.as_of(a, b.limit(0), ("k", "key"), ("t", "at"), ["n"]).where("n IS NOT NULL").count() == 0 and times.as_of(a.limit(0), b, ("k", "key"), ("t", "at"), ["n"]).count() == 0


def test_intervals_against_brute_force(spark):
    r = random.Random(10)
    points = [(r.choice([1, 1, 2, None]), None if r.random() < 0.05 else START + timedelta(seconds=r.randrange(100_000)), i) for i in range(300)]
    spans = []
    for i in range(200):
        a = START + timedelta(seconds=r.randrange(-1000, 100_000))
        spans.append((r.choice([1, 1, 2, None]), a, r.choice([a, None, a - timedelta(seconds=5), a + timedelta(seconds=2 ** r.randrange(18)), a + timedelta(seconds=r.randrange(1, 200_000)), a + timedelta(microseconds=1)]), i))
    spans += [(1, points[i][1], points[i][1] + timedelta(seconds=7), 500 + i) for i in range(9) if points[i][1]]
    a = spark.createDataFrame(points, "k long, t timestamp_ntz, i long")
    b = spark.createDataFrame(spans, "k long, a timestamp_ntz, b timestamp_ntz, i long")
    found = times.in_intervals(a, b, ("k", "k"), "t", "a", "b")
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    expected = {(p[2], s[3]) for p in points for s in spans if None not in (p[0], p[1], s[2]) and p[0] == s[0] and s[1] <= p[1] < s[2]}
    rows = [(x.point.i, x.interval.i) for x in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected and len(expected) > 1000
    assert times.in_intervals(a, b.limit(0), ("k", "k"), "t", "a", "b").count() == 0


def test_points_make_a_row_for_each_band_of_lengths(spark):
    a = spark.createDataFrame([(1, START + timedelta(hours=i)) for i in range(200)], "k long, t timestamp_ntz")
    b = spark.createDataFrame([(1, START + timedelta(hours=i), START + timedelta(hours=i, days=1 + i % 50)) for i in range(200)], "k long, a timestamp_ntz, b timestamp_ntz")
    found = times.in_intervals(a, b, ("k", "k"), "t", "a", "b")
    bands = re.search(r"explode\(\[([\d,]+)\]", plan(found))[1].split(",")
    assert len(bands) == 2 and found.count() == sum(i <= j < i + 24 * (1 + i % 50) for i in range(200) for j in range(200))


def records(spark, rows):
    return spark.createDataFrame(rows, DDL)


def test_profiles_grow_by_batches(spark, tmp_path):
    r = random.Random(3)
    rows = [([r.choice("mn")] if r.random() < 0.9 else [], [r.choice(["ocean", "none", "land"]) for _ in range(r.randrange(3))], r.choice(["k", None, "l"])) for _ in range(90)]
    store = ProfileStore(spark, f"{tmp_path}/p", TWO)
    assert store.read().count() == 0
    shown = lambda frame: collections.Counter(map(tuple, frame.collect()))
    whole = lambda some: shown(profile.entity_profile(records(spark, some), TWO))
    store.apply(records(spark, rows[:30]), "1")
    store.apply(records(spark, rows[30:60]), "02")
    store.apply(records(spark, rows[:30]), "1")
    store.apply(records(spark, []), "none")
    assert shown(store.read()) == whole(rows[:60])
    store.fold()
    assert store.generation() == 1 and shown(store.read()) == whole(rows[:60]) and {x.batch for x in store.folded(1).collect()} == {"1", "02"}
    # A batch that the base holds counts no more; another process sees the same.
    store.apply(records(spark, rows[:30]), "1")
    store.apply(records(spark, rows[60:]), "3")
    again = ProfileStore(spark, store.path, TWO)
    again.fold()
    again.fold()
    assert again.generation() == 2 and shown(again.read()) == whole(rows)
    again.apply(records(spark, rows[:45]), "back", taken_back=True)
    assert shown(again.read()) == whole(rows[45:])
    with pytest.raises(ValueError, match="a batch's id"):
        store.apply(records(spark, rows), "a/b")


def test_batches_of_the_query_join_the_catalogue_once(spark, monkeypatch):
    from tesserae.plans import queries

    seen, plain = [], ProfileStore.apply

    def apply(self, batch_records, batch, taken_back=False):
        seen.append(plan(batch_records))
        plain(self, batch_records, batch, taken_back)

    monkeypatch.setattr(ProfileStore, "apply", apply)
    sf = "/root/testdata/sf0.001"
    got = {tuple(r) for r in queries.incremental_profile(spark, sf).collect()}
    assert got == {tuple(r) for r in queries.entity_facet_profile(spark, sf).collect()}
    assert len(seen) == 7 and not any("Join" in p for p in seen)


def test_profiles_follow_streams(spark, tmp_path):
    rows = [(["m"], ["ocean"], "k"), (["m"], ["land", "ocean"], None), (["n"], ["none"], "l")]
    folder, store = f"{tmp_path}/in", ProfileStore(spark, f"{tmp_path}/p", TWO)
    for part in (rows[:2], rows[2:]):
        records(spark, part).write.mode("append").parquet(folder)
        query = store.follow(spark.readStream.schema(DDL).parquet(folder), "s", f"{tmp_path}/checkpoint")
        query.awaitTermination(60)
    # The last batch comes again, as after a failure between its counts and the stream's commit.
    store.apply(records(spark, rows[2:]), "s-1")
    assert {tuple(x) for x in store.read().collect()} == {tuple(x) for x in profile.entity_profile(records(spark, rows), TWO).collect()}


def test_predicates_are_applied_as_written(spark):
    words = ["a", "it's", "back\\slash", 'quo"te', "x & y", "['z']", "", "none", "a,b", "Ü", "#0", "(p)"]
    r = random.Random(5)
    rows = [([r.choice(words) for _ in range(r.randrange(3))] or None, None if r.random() < 0.1 else r.choice(words)) for _ in range(150)]
    schema = FacetSchema((Facet("m", True), Facet("s")))
    df = spark.createDataFrame(rows, "m array<string>, s string")
    for _ in range(6):
        chosen, more = r.sample(words[:6], 2), r.sample(words, 3)
        own = df.where(F.col("s").isin(chosen) & F.arrays_overlap("m", F.array(*map(F.lit, more))))
        text = predicates.predicate_string(own, ["m", "s"]).first()[0]
        if not text:
            continue
        values = {n: {v for row in own.collect() for v in ((row.m or []) if n == "m" else [row.s]) if v and v.lower() != "none"} for n in "ms"}
        expected = [x for x in rows if x[1] in values["s"] and set(x[0] or []) & values["m"]]
        assert sorted(map(str, map(tuple, df.where(predicates.applied(text, schema)).collect()))) == sorted(map(str, expected)), text
    count = lambda text: df.where(predicates.applied(text, schema)).count()
    is_a = lambda x: x[1] == "a"
    assert count("s == 'a'") == count('s in ["a"]') == sum(map(is_a, rows)) and count("s != 'a'") == count("s not in ['a']") == sum(not is_a(x) for x in rows)
    assert count("(s == 'a' | m == 'a') & not s == 'none'") == sum(is_a(x) or "a" in (x[0] or []) for x in rows if x[1] is not None and x[1] != "none")
    assert count("") == 150 and count("s == []") == 0 and count("m == ['']") == sum("" in (x[0] or []) for x in rows)
    for wrong in ("s == a", "s = 'a'", "s == 'a' ; DROP", "s == 'a' & count(*)", "x'a' == 's'"):
        with pytest.raises((ValueError, KeyError)):
            predicates.applied(wrong, schema)
    with pytest.raises(KeyError, match="no facet"):
        predicates.applied("t == 'a'", schema)


def test_predicates_reach_the_scan(spark):
    from tesserae.plans.queries import QUERIES

    filtered = plan(QUERIES["predicate_applied"](spark, "/root/testdata/sf0.001"))
    assert "In(o_orderpriority" in filtered and "EqualTo(c_mktsegment,BUILDING)" in filtered


def test_sketches_merge_and_stay_near(spark):
    r = random.Random(12)
    rows = [(r.randrange(3000), r.choice("ab") if i % 50 else None, [r.choice(["x", "y", "none"]) for _ in range(r.randrange(3))], r.gauss(0, 10)) for i in range(20_000)]
    rows += [(None, "empty", [], None)] * 3
    df = spark.createDataFrame(rows, "who long, s string, m array<string>, price double")
    parts = [sketches.sketched(df.where(c), ["s", "m"], "who", "price") for c in ("who % 2 = 0", "who % 2 = 1 OR who IS NULL")]
    both = sketches.merged(parts[0].union(parts[1]), ["facet", "value"])
    got = {(x.facet, x.value): x for x in sketches.told(both, [0.1, 0.5]).collect()}
    assert set(got) == {("s", "a"), ("s", "b"), ("s", "empty"), ("m", "x"), ("m", "y")}
    assert (got["s", "empty"].n, got["s", "empty"].distinct, got["s", "empty"].quantiles) == (3, 0, None)
    for (facet, value), x in got.items():
        own = [row for row in rows for v in ([row[1]] if facet == "s" else row[2]) if v == value]
        assert x.n == len(own)
        if value != "empty":
            assert abs(x.distinct - len({o[0] for o in own})) <= 0.05 * x.distinct
            for rank, q in zip((0.1, 0.5), x.quantiles):
                assert abs(sum(o[3] <= q for o in own) / len(own) - rank) <= 0.03
    asked = spark.createDataFrame([("ab", "s", "a"), ("ab", "s", "b"), ("ab", "s", "b"), ("no", "s", "q")], "name string, facet string, value string")
    [one] = sketches.any_of(both, asked, [0.5]).collect()
    assert one.name == "ab" and one.n == sum(x[1] in ("a", "b") for x in rows if x[1]) and abs(one.distinct - 3000) < 150


def test_suggestions_are_walks_from_the_entity(spark):
    r = random.Random(2)
    counts = {(f"e{i}", r.choice("fg"), r.choice("uvwxyz")): r.randrange(1, 9) for i in range(7) for _ in range(5)}
    rows = [(*k, n) for k, n in counts.items()] + [("alone", "h", "only", 3), (None, "f", "u", 50)]
    frame = spark.createDataFrame(rows, "entity string, facet string, value string, n long")
    known = {k: n for *k, n in ((e, (f, v), n) for e, f, v, n in rows if e) for k in [tuple(k)]}
    size = lambda e=None, f=None, v=None: sum(n for (a, (b, c)), n in known.items() if e in (None, a) and f in (None, b) and v in (None, c))
    lift = {(e, x): n * size(f=x[0]) / (size(e, x[0]) * size(f=x[0], v=x[1])) for (e, x), n in known.items()}
    lift = {k: w for k, w in lift.items() if w > 1}
    down, up = collections.Counter(), collections.Counter()
    for (e, x), w in lift.items():
        down[e] += w
        up[x] += w
    expected = set()
    for start in down:
        at, total = {start: 1.0}, collections.Counter()
        for _ in range(4):
            values = collections.Counter()
            for (e, x), w in lift.items():
                values[x] += at.get(e, 0) * w / down[e]
            total.update(values)
            at = collections.Counter()
            for (e, x), w in lift.items():
                at[e] += 0.8 * values[x] * w / up[x]
        best = sorted(((-round(0.2 * p, 9), x) for x, p in total.items() if p), key=lambda y: (y[0], y[1]))[:5]
        expected |= {(start, *x, -p, i + 1) for i, (p, x) in enumerate(best)}
    assert {tuple(x) for x in related.suggestions(frame).collect()} == expected and "alone" not in {x[0] for x in expected}
    assert related.suggestions(frame.limit(0)).count() == 0
