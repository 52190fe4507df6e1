"""Chunks of texts that come late, out of order and more than once, given out in their order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def in_order(chunks: DataFrame, key: str, number: str, carry: list[str], first: int = 0) -> DataFrame:
    """key, number, the columns to carry (as strings) and place: the chunks of each key once each, in the order of their
    numbers, which count up from first; place counts what was given out of a key.

    chunks: a stream. A chunk waits in the key's state until all before it have come. A number that was given out, or waits
    already, is dropped, and so are numbers below the first and null ones. What a missing chunk holds back stays in the state,
    across restarts, until it comes. State holds what waits and no more; a key's chunks of one batch go through one task, as
    their order asks.
    """
    columns = [f"c{i}" for i in range(len(carry))]

    def give_out(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting: dict[int, tuple] = {}
        due, given = first, 0
        if state.exists:
            due, given, numbers, *parts = state.get
            waiting = dict(zip(numbers, zip(*parts) if parts else ((),) * len(numbers)))
        for batch in batches:
            for n, *rest in batch[["_number", *columns]].itertuples(index=False, name=None):
                if not pd.isna(n) and n >= due:
                    waiting.setdefault(int(n), tuple(None if pd.isna(x) else x for x in rest))
        rows = []
        while due in waiting:
            rows.append((due, *waiting.pop(due), given + len(rows)))
            due += 1
        rest = sorted(waiting)
        state.update((due, given + len(rows), rest, *([waiting[n][i] for n in rest] for i in range(len(columns)))))
        if rows:
            found = pd.DataFrame(rows, columns=["_number", *columns, "place"])
            found.insert(0, "_key", pd.Series([who[0]] * len(found), dtype=object))
            yield found

    given = chunks.select(F.col(key).alias("_key"), F.col(number).cast("long").alias("_number"), *(F.col(c).cast("string").alias(x) for c, x in zip(carry, columns)))
    kind = given.schema["_key"].dataType.simpleString()
    out = f"_key {kind}, _number long, {''.join(f'{c} string, ' for c in columns)}place long"
    kept = f"due long, given long, numbers array<long>{''.join(f', {c} array<string>' for c in columns)}"
    ordered = given.groupBy("_key").applyInPandasWithState(give_out, out, kept, "append", GroupStateTimeout.NoTimeout)
    return ordered.select(F.col("_key").alias(key), F.col("_number").alias(number), *(F.col(x).alias(c) for c, x in zip(carry, columns)), "place")
