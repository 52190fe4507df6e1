"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.staging import stage_root, staged, unstage  # noqa: F401  (operators take them from here)

#: What separates words, as a class of Java and Python patterns.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ship(module: str) -> None:
    """Send a module's functions to Python workers by value, so that workers need no path to this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def id_key(key: Column) -> Column:
    """An id as text that is never null, so that joins and windows deal rows out by the same columns."""
    return F.when(key.isNull(), "null").otherwise(F.concat(F.lit("id "), key.cast("string")))


def is_finite_vector(vector: Column) -> Column:
    """Neither null nor with an entry that is null or not finite; an empty vector is one too."""
    bounded = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, bounded), F.lit(False))


def in_shuffle(df: DataFrame) -> DataFrame:
    """df, for a join that shuffles both sides. Files of ids are compressed, so by their size a table that takes 100 MB and
    more on the driver, and in every executor, would still be broadcast."""
    return df.hint("merge")


#: Words of 64 bits in a sieve, of which each is a row of what is broadcast: 4 MB of them at most, whatever the corpus.
SIEVE = 1 << 18


def sieve(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """rows with _maybe: false only for rows whose keys are not in wanted, true for the others and some more.

    A filter of fixed size, so that what a join doesn't need isn't shuffled to it. Of more keys than it has bits it lets
    nearly all through: the join behind it is right in any case. keys: names that both frames have.
    """
    hashed = lambda df: df.withColumn("_h", F.xxhash64(*keys)).withColumns({"_slot": F.pmod("_h", F.lit(SIEVE)), "_bit": F.expr("shiftleft(1L, CAST(pmod(shiftright(_h, 40), 64) AS INT))")})
    bits = hashed(wanted.select(*keys)).groupBy("_slot").agg(F.bit_or("_bit").alias("_bits"))
    met = hashed(rows).join(F.broadcast(bits), "_slot", "left")
    return met.withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))).drop("_h", "_slot", "_bit", "_bits")
