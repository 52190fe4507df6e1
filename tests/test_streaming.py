"""Streams against tables: restarts, late rows, rows that come twice, gaps."""

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tesserae.streaming.chunks import in_order
from tesserae.streaming.run import arriving, drained
from tesserae.streaming.sessions import sessions

EVENTS = "user_id long, ts timestamp, event_id long, value double, n string"


def events(spark, rows):
    return spark.createDataFrame([(u, None if t is None else f"2024-01-01 {t}", e, 1.0, "own") for u, t, e in rows], "user_id long, ts string, event_id long, value double, n string").withColumn("ts", F.col("ts").cast("timestamp"))


def shown(frame):
    return sorted((str(r.user_id), r.started.strftime("%H:%M"), r.ended.strftime("%H:%M"), r.n, r.total) for r in frame.collect())


def test_sessions_of_a_table(spark):
    rows = [(1, "00:00", 1), (1, "00:09", 2), (1, "00:09", 2), (1, "00:18", 3), (1, "00:28", 4), (1, "01:00", 9), (2, "00:00", 5), (None, "00:00", 6), (None, "00:05", 7), (3, None, 8)]
    got = shown(sessions(events(spark, rows), "10 minutes", "1 hour"))
    # A pause as long as the gap is still within a session.
    assert got == [("1", "00:00", "00:38", 4, 4.0), ("1", "01:00", "01:10", 1, 1.0), ("2", "00:00", "00:10", 1, 1.0), ("None", "00:00", "00:15", 2, 2.0)]
    assert shown(sessions(events(spark, []), "10 minutes", "1 hour")) == []


def test_sessions_of_a_stream(spark, tmp_path):
    folder, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))

    def come(rows):
        part = events(spark, rows)
        part.write.mode("append").parquet(folder)
        return shown(drained(sessions(arriving(spark, folder, part.schema), "10 minutes", "30 minutes"), out, checkpoint))

    assert come([(1, "00:00", 1), (1, "00:05", 2), (2, "00:20", 3)]) == []
    # The watermark is 00:30 now: what ended by then is out. 4 is late but in time, and joins 3's session; 2 comes again.
    first = [("1", "00:00", "00:15", 2, 2.0)]
    assert come([(2, "01:00", 5), (2, "00:25", 4), (1, "00:05", 2)]) == first
    got = come([(3, "02:00", 6), (1, "00:01", 9)])
    # 9 came after its watermark and is left out; 3's session is still open.
    assert got == [*first, ("2", "00:20", "00:35", 2, 2.0), ("2", "01:00", "01:10", 1, 1.0)]
    # A run without news gives out nothing twice.
    assert shown(drained(sessions(arriving(spark, folder, events(spark, []).schema), "10 minutes", "30 minutes"), out, checkpoint)) == got


def test_a_stopped_stream_goes_on(spark, tmp_path):
    folder, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))
    r = random.Random(1)
    rows = [(c, t, f"{c}-{t}") for c in range(12) for t in range(9)]
    r.shuffle(rows)
    sent = rows + rows[4:40]
    for i in range(6):
        spark.createDataFrame(sent[i::6], "conv long, turn long, text string").coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    come = lambda: arriving(spark, folder, schema, files_at_once=1)
    # One batch of several fails; the next run goes on from the last one that was whole.
    fails = come().where(F.when(F.col("text") == sent[3][2], F.raise_error(F.lit("lost")).isNull()).otherwise(True))
    with pytest.raises(StreamingQueryException, match="lost"):
        drained(in_order(fails, "conv", "turn", ["text"]), out, checkpoint)
    assert 0 < len(list((tmp_path / "checkpoint" / "commits").glob("[0-9]*"))) < 6
    got = drained(in_order(come(), "conv", "turn", ["text"]), out, checkpoint).collect()
    assert sorted((x.conv, x.turn, x.text, x.place) for x in got) == sorted((c, t, text, t) for c, t, text in rows)


def test_gaps_and_odd_chunks(spark, tmp_path):
    folder, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))

    def come(rows):
        part = spark.createDataFrame(rows, "k string, n int, a string, b double")
        part.write.mode("append").parquet(folder)
        stream = in_order(arriving(spark, folder, part.schema), "k", "n", ["a", "b"], first=1)
        return sorted(((x.k, x.n, x.a, x.b, x.place) for x in drained(stream, out, checkpoint).collect()), key=str)

    # Null numbers and ones below the first are dropped; null texts and null keys are like others.
    got = come([("x", 1, None, 1.5), ("x", 3, "c", None), ("x", None, "?", 0.0), ("x", 0, "?", 0.0), (None, 1, "n", 2.0)])
    assert got == sorted([("x", 1, None, "1.5", 0), (None, 1, "n", "2.0", 0)], key=str)
    got = come([("x", 2, "b", 0.0), ("x", 1, "again", 0.0), ("x", 3, "again", 0.0), ("x", 6, "f", 1.0)])
    assert [g[1:] for g in got if g[0] == "x"] == [(1, None, "1.5", 0), (2, "b", "0.0", 1), (3, "c", None, 2)]


def test_an_empty_folder_is_an_error_of_spark(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        arriving(spark, f"{tmp_path}/nowhere", events(spark, []).schema)
