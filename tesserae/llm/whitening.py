"""Whitening of embeddings by the singular values of their centred rows.

Entries are put on a grid of whole numbers, so that counts, sums and deviations are exact. Each distinct vector of the grid
counts once for the fit, however many copies a group has. MLlib's computeSVD runs over the centred rows where they lie; the
squares of its singular values, by the number of vectors, are the components' variances. What all dimensions vary in total
comes from the exact deviations and not from the singular values, so that it tells what the components leave out.

The driver gets numbers of each dimension and of each pair of dimensions, of which MLlib allows 15,000 dimensions; everything
else stays distributed. The vectors of the fit are written once to the shared folder.

Defined cases: a vector that is null or holds a null or an entry that isn't finite is left out; an empty one is kept; one
that is shorter than the longest counts as if it ended in zeros; repeated rows, ids and null ids are rows of their own; a
component whose variance is below 1e-10 of the largest can't be told from rounding and is none, so that vectors that are all
alike, a single one, or none at all have no components; other columns are left out. Numbers that leave their type are an
error, for they have no result: a number of the grid, or n times it, from 2 ** 63 on, and a deviation from 10 ** 38 on, or from
2 ** 63 on where it is asked for as long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import is_finite_vector, ship, staged, unstage

ship(__name__)

#: Steps of the grid in a unit, and what is added so that its numbers are positive; most components.
STEPS, ABOVE, COMPONENTS = 64, 1_000_000, 16
#: A singular value below this part of the largest one is none.
LEAST = 1e-5


@dataclass(frozen=True)
class Whitening:
    """What a fit has found. axes: a row for each component, by falling variance; each has its largest entry positive."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    total: float
    identity_error: float

    @property
    def explained(self) -> list[float]:
        return [float(e) / self.total for e in self.variances]


def on_grid(vector: Column, width: int) -> Column:
    """floor(STEPS * entry) + ABOVE of each entry, as long; what is missing of the width counts as zeros."""
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * STEPS) + F.lit(ABOVE).cast("long"))
    return F.concat(x, F.array_repeat(F.lit(ABOVE).cast("long"), F.lit(width) - F.size(vector)))


def literal(values: list, kind: str) -> Column:
    return F.lit(values).cast(f"array<{kind}>")


def gaps(x: Column, n: int, sums: list[int]) -> Column:
    """n * x - S of each dimension, exact."""
    return F.zip_with(x, literal(sums, "bigint"), lambda v, s: F.lit(n).cast("long") * v - s)


def centred(x: Column, n: int, sums: list[int]) -> Column:
    """x - S / n as doubles: the difference is exact before it is rounded."""
    return F.transform(gaps(x, n, sums), lambda g: g.cast("double") / float(n))


def deviation(x: Column, n: int, sums: list[int]) -> Column:
    """Sum over dimensions of (n * x - S) ** 2, exact, as decimal(38, 0)."""
    square = lambda g: g.cast("decimal(19,0)") * g.cast("decimal(19,0)")
    return F.aggregate(gaps(x, n, sums), F.lit(0).cast("decimal(38,0)"), lambda s, g: (s + square(g)).cast("decimal(38,0)"))


def rows_of(frame: DataFrame, column: Column) -> RowMatrix:
    """A distributed matrix of a column of arrays; rows go to it inside the JVM."""
    return RowMatrix(MLUtils.convertVectorColumnsFromML(frame.select(array_to_vector(column).alias("v")), "v"))


def projected(frame: DataFrame, x: str, n: int, sums: list[int], axes: np.ndarray, variances: np.ndarray, to: str = "whitened") -> DataFrame:
    """frame with the whitened numbers of the grid vectors in x, which goes: a product of matrices for each batch."""
    scaled = (axes / np.sqrt(variances)[:, None]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("_centred")
            numbers = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(sums)) @ scaled
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * scaled.shape[1])
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            names = [c for i, c in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.ListArray.from_arrays(ends, pa.array(numbers.ravel()))], [*names, to])

    given = frame.withColumn("_centred", centred(F.col(x), n, sums)).drop(x)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields if f.name != "_centred")
    return given.mapInArrow(run, ", ".join(filter(None, (kinds, f"`{to}` array<double>"))))


def fit(vectors: DataFrame, most: int = COMPONENTS, x: str = "x") -> Whitening | None:
    """The whitening of the distinct vectors in x, which all have one length; None where nothing varies."""
    distinct = staged(vectors.select(F.col(x).alias("x")).distinct(), "whitening-fit")
    places = distinct.select(F.posexplode("x").alias("place", "v")).groupBy("place").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    found = sorted(places.collect())
    if not found:
        return None
    n, sums = found[0].n, [r.s for r in found]
    total = distinct.agg(F.sum(deviation(F.col("x"), n, sums).cast("double"))).first()[0] / n / n / n
    if total == 0:
        return None
    # Asked for all components, computeSVD decomposes the product of the rows with themselves in double precision; for a few
    # it would iterate to a tolerance.
    svd = rows_of(distinct, centred(F.col("x"), n, sums)).computeSVD(len(sums), computeU=False, rCond=LEAST)
    variances = svd.s.toArray() ** 2 / n
    order = np.argsort(-variances, kind="stable")[:most]
    variances, axes = variances[order], svd.V.toArray().T[order]
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]

    white = projected(distinct, "x", n, sums, axes, variances)
    means = rows_of(white, F.col("whitened")).computeColumnSummaryStatistics().mean()
    around = F.zip_with("whitened", literal([float(m) for m in means], "double"), lambda a, m: a - m)
    covariance = rows_of(white, around).computeGramianMatrix().toArray() / n
    unstage(distinct)
    return Whitening(n, sums, axes, variances, total, float(np.abs(covariance - np.eye(len(axes))).max()))


def whiten(frame: DataFrame, vector: str = "embedding", key: str = "vec_id", most: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """key, deviation (decimal), whitened (a number for each component) of every row that can be compared, and the fit."""
    rows = frame.select(F.col(key).alias("_key"), F.col(vector).alias("_vector")).where(is_finite_vector(F.col("_vector")))
    width = rows.agg(F.max(F.size("_vector"))).first()[0] or 0
    grid = rows.select("_key", on_grid(F.col("_vector"), width).alias("x"))
    found = fit(grid, most)
    if found is None:
        none = rows.select(F.col("_key").alias(key), F.lit(0).cast("decimal(38,0)").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
        return none, None
    told = grid.withColumn("deviation", deviation(F.col("x"), found.n, found.sums))
    return projected(told, "x", found.n, found.sums, found.axes, found.variances).withColumnRenamed("_key", key), found
