"""Sessions of events: stretches in which no pause is longer than the gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str, delay: str, key: str = "user_id", time: str = "ts", event: str = "event_id", value: str = "value") -> DataFrame:
    """key, started, ended (the last event and the gap), n, total (sum of value) of each session.

    events: a stream or a table. Of a stream, events may come late by the delay and more than once within it: an event counts
    once, and a session is given out when no event can reach it any more, that is when its end is not after the latest event
    less the delay; state holds what is younger than that. A table's sessions are all given out. An event whose key is null
    makes sessions with others like it; one without a time belongs to none; rows with one event id are one event.
    """
    rows = events.select(F.col(key).alias("_key"), F.col(time).cast("timestamp").alias("_time"), F.col(event).alias("_event"), F.col(value).alias("_value")).where("_time IS NOT NULL")
    if events.isStreaming:
        rows = rows.withWatermark("_time", delay).dropDuplicatesWithinWatermark(["_event"])
    else:
        rows = rows.dropDuplicates(["_event"])
    found = rows.groupBy("_key", F.session_window("_time", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("_value").alias("total"))
    kind = dict(events.dtypes)[time]
    return found.select(F.col("_key").alias(key), F.col("w.start").cast(kind).alias("started"), F.col("w.end").cast(kind).alias("ended"), "n", "total")
