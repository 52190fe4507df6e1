"""Combinations of many-valued parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_default(values: Column, default: str) -> Column:
    """A list, or one of the default alone where it is null or empty."""
    return F.when(F.size(F.coalesce(values, F.array().cast("array<string>"))) > 0, values).otherwise(F.array(F.lit(default)))


def combinations(frame: DataFrame, keys: list[str], parameters: list[str]) -> DataFrame:
    """A row for each choice of one value of every parameter. Generators in a chain: nothing is shuffled.

    A parameter whose list is null or empty offers no choice: it is null in all rows, which stands for any value.
    """
    out = frame.select(*keys, *parameters)
    for p in parameters:
        out = out.withColumn(p, F.explode_outer(p))
    return out


def combination_count(parameters: list[str]) -> Column:
    """How many rows combinations() makes of a row, to look before leaping."""
    out = F.lit(1).cast("long")
    for p in parameters:
        out = out * F.greatest(F.lit(1), F.coalesce(F.size(p), F.lit(0)))
    return out
