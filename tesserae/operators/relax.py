"""Which constraints to drop so that a search finds something: all minimal sets of them, from one pass over the records.

Each record gets a mask of the constraints that it meets, and one count for each mask is all that is kept of the records: as
many numbers at most as there are sets of constraints. What a set of kept constraints finds is the sum over the masks that
hold it. These sums go down the lattice of sets, four constraints at a time, and only then are sets compared, so that nothing
after the first count grows with the catalogue.

Defined cases: a facet that is null or without values meets no constraint; without constraints the only set is the empty one;
an empty catalogue has no set that finds anything; more than MOST constraints are an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.predicates import Constraints, condition, normalized
from tesserae.schema import FacetSchema

#: Most constraints, whose sets are a million; how many of them are summed before sums of equal sets meet.
MOST, AT_ONCE = 20, 4


def masks(records: DataFrame, schema: FacetSchema, constraints: Constraints) -> DataFrame:
    """mask, n: how many records meet exactly the constraints of a mask. Bit i is the i-th constraint that has values."""
    names = list(normalized(constraints))
    if len(names) > MOST:
        raise ValueError(f"{len(names)} constraints have too many sets; {MOST} at most")
    bits = [F.when(condition(schema, {n: constraints[n]}), F.lit(1 << i)).otherwise(F.lit(0)) for i, n in enumerate(names)]
    return records.select(reduce(lambda a, b: a + b, bits, F.lit(0)).alias("mask")).groupBy("mask").agg(F.count("*").alias("n"))


def lattice(counts: DataFrame, bits: int) -> DataFrame:
    """kept, hits: of each set of constraints that is met at all, how many records meet all of it."""
    sums = counts.select(F.col("mask").alias("kept"), F.col("n").alias("hits"))
    for first in range(0, bits, AT_ONCE):
        for i in range(first, min(first + AT_ONCE, bits)):
            without = F.when(F.col("kept").bitwiseAND(F.lit(1 << i)) > 0, F.array("kept", F.col("kept") - (1 << i))).otherwise(F.array("kept"))
            sums = sums.select(F.explode(without).alias("kept"), "hits")
        sums = sums.groupBy("kept").agg(F.sum("hits").alias("hits"))
    return sums


def named(sets: DataFrame, names: list[str]) -> DataFrame:
    """dropped (in the order of the constraints), hits."""
    gone = F.array_compact(F.array(*(F.when(F.col("kept").bitwiseAND(F.lit(1 << i)) == 0, F.lit(n)) for i, n in enumerate(names))).cast("array<string>"))
    return sets.select(gone.alias("dropped"), "hits")


def relaxations(records: DataFrame, schema: FacetSchema, constraints: Constraints) -> DataFrame:
    """dropped, hits of all sets of constraints whose dropping leaves records."""
    names = list(normalized(constraints))
    return named(lattice(masks(records, schema, constraints), len(names)), names)


def minimal(records: DataFrame, schema: FacetSchema, constraints: Constraints, wanted: int = 1) -> DataFrame:
    """dropped, hits of the sets whose dropping leaves as many records as are wanted, and of which no part does. If the search
    itself finds as many, that is the empty set alone."""
    names = list(normalized(constraints))
    enough = lattice(masks(records, schema, constraints), len(names)).where(F.col("hits") >= wanted)
    # A set from which one more constraint is dropped than from one that is enough isn't minimal, and no other is.
    one_less = F.array_compact(F.array(*(F.when(F.col("kept").bitwiseAND(F.lit(1 << i)) > 0, F.col("kept") - (1 << i)) for i in range(len(names)))).cast("array<int>"))
    beyond = enough.select(F.explode(one_less).alias("kept")).distinct()
    return named(enough.join(beyond, "kept", "left_anti"), names)
