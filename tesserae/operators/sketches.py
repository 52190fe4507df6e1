"""Sketches of a catalogue's facets: how many things a value has, and how a number is spread there, without the records.

Each value of a facet gets a sketch of the distinct things among its records (HLL) and one of a number's quantiles (KLL). A
sketch has a bounded size, whatever it has seen, and sketches merge: those of several values answer any-of constraints, and
those of a new batch of records join what is stored. Neither reads the records again.

Errors: with 2 ** LG_K registers, distinct counts deviate by 1.04 / sqrt(2 ** LG_K), 1.6 %, at one standard deviation; a
quantile's rank is off by 1.4 % at most in 99 of 100 cases (K = 200).

Defined cases: sentinels, empty values and nulls of a facet have no sketch; null things and null numbers are not seen, and a
value that has only such has 0 things and null quantiles; a record that lists a value twice, or several values of one
constraint, counts once among the things, and as often as it stands in n and among the numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.predicates import is_value, values_of

LG_K, K = 12, 200


def sketched(records: DataFrame, names: list[str], things: str, number: str) -> DataFrame:
    """facet, value, n, things, numbers: of each value the number of its records and two sketches."""
    found = values_of(records.withColumns({"#things": F.col(things), "#number": F.col(number).cast("double")}), names, ["#things", "#number"]).where(is_value(F.col("value")))
    return found.groupBy("facet", "value").agg(F.count("*").alias("n"), F.hll_sketch_agg("#things", LG_K).alias("things"), F.kll_sketch_agg_double("#number", K).alias("numbers"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of equal keys made one: of values that a constraint names, or of batches."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("things").alias("things"), F.kll_merge_agg_double("numbers", K).alias("numbers"))


def told(sketches: DataFrame, ranks: list[float]) -> DataFrame:
    """sketches with distinct, and quantiles (an array, a number for each rank) in the sketches' place."""
    rest = [c for c in sketches.columns if c not in ("things", "numbers")]
    some = F.kll_sketch_get_n_double("numbers") > 0
    quantiles = F.when(some, F.array(*(F.kll_sketch_get_quantile_double("numbers", F.lit(float(r))) for r in ranks)))
    return sketches.select(*rest, F.hll_sketch_estimate("things").alias("distinct"), quantiles.alias("quantiles"))


def any_of(sketches: DataFrame, constraints: DataFrame, ranks: list[float]) -> DataFrame:
    """name, n, distinct, quantiles of each constraint. constraints: name, facet, value, of which the values of one name are
    those of one facet."""
    met = sketches.join(constraints.select("name", "facet", "value").distinct(), ["facet", "value"])
    return told(merged(met, ["name"]), ranks)
