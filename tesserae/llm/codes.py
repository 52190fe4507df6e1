"""Compression of vectors to codes: each part of a vector becomes the index of its nearest codebook entry.

A codebook is searched by a VA-file. Each coordinate of its entries is quantised to a few bits, that is to one of some cells;
a cell is the stretch between the least and the largest coordinate that fall in it. For a part that asks, lookup tables hold
the least and the largest squared distance from each of its coordinates to each cell of that coordinate; their sums bound its
distance to every entry. Only entries whose lower bound doesn't exceed the least upper bound are refined, with exact distances
in whole numbers. The nearest entry is always among these, and so are all that are as near, of which the least index counts.

Codebooks start from the parts of the vectors with the least ids. A round is one job: each task assigns its rows and sends
sums and counts of each entry, and what reaches the driver are as many numbers as the codebooks have. No round writes or
shuffles rows.

Defined cases: a vector that is null or holds a null or a component that isn't finite is left out; an empty one is kept;
shorter vectors count as if they ended in zeros, and all do up to a multiple of the number of parts; equal ids are ordered by
their vectors, null ids come last; repeated rows are rows of their own; of fewer rows than entries, codebooks have as many
entries as there are rows; no rows give none; other columns are left out but for those that are asked for. Where a sum of
squares may leave 62 bits (components of some 10,000 at 64 dimensions), an error says so, for such distances have no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import is_finite_vector, ship, staged

ship(__name__)

#: Steps of a component's unit; parts of a vector; entries of a codebook; rounds; bits of an entry's coordinate.
STEPS, PARTS, ENTRIES, ROUNDS, BITS = 4096, 8, 16, 6, 3
#: Parts whose tables are made at once.
AT_ONCE = 4096


class VAFile:
    """Entries of one codebook: a row of whole numbers for each, and the cells that its coordinates fall in."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        n, width = entries.shape
        cells = min(1 << bits, n)
        # Cells of about as many entries each, by rank in the coordinate's order.
        ranks = np.argsort(np.argsort(entries, 0, kind="stable"), 0, kind="stable")
        self.cell = ranks * cells // n
        self.low, self.high = np.empty((width, cells), np.int64), np.empty((width, cells), np.int64)
        for c in range(cells):
            inside = self.cell == c
            self.low[:, c] = np.where(inside, entries, np.iinfo(np.int64).max).min(0, initial=np.iinfo(np.int64).max)
            self.high[:, c] = np.where(inside, entries, np.iinfo(np.int64).min).max(0, initial=np.iinfo(np.int64).min)
        self.at = np.arange(width) * cells + self.cell

    def bounds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest squared distance that each part can have to each entry, by the cells alone."""
        q = parts[:, :, None]
        below, above = self.low - q, q - self.high
        least = np.maximum(np.maximum(below, above), 0) ** 2
        most = np.maximum(np.abs(below), np.abs(above)) ** 2
        return (t.reshape(len(parts), -1)[:, self.at].sum(2) for t in (least, most))

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of the nearest entry of each part, and how many distances were refined."""
        index, distance, refined = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64), 0
        for a in range(0, len(parts), AT_ONCE):
            some = parts[a : a + AT_ONCE]
            least, most = self.bounds(some)
            rows, candidates = np.nonzero(least <= most.min(1)[:, None])
            refined += len(rows)
            exact = np.full(least.shape, np.iinfo(np.int64).max)
            exact[rows, candidates] = ((some[rows] - self.entries[candidates]) ** 2).sum(1)
            index[a : a + AT_ONCE] = exact.argmin(1)
            distance[a : a + AT_ONCE] = exact.min(1)
        return index, distance, refined


def in_steps(vector: Column, width: int) -> Column:
    """floor(STEPS * component) of each, as long; what is missing of the width counts as zeros."""
    return F.concat(F.transform(vector, lambda x: F.floor(x.cast("double") * STEPS)), F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(vector)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    out = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
    largest = max(-int(out.min(initial=0)), int(out.max(initial=0)))
    if 4 * largest * largest * max(width, 1) >= 1 << 62:
        raise OverflowError(f"components up to {largest / STEPS:g} in {width} dimensions have squared distances that leave 64 bits")
    return out


def train(rows: DataFrame, books: np.ndarray, rounds: int, bits: int) -> np.ndarray:
    """The codebooks (parts by entries by places) after so many rounds over all rows' column x."""
    parts, entries, width = books.shape
    for _ in range(rounds):
        files = [VAFile(b, bits) for b in books]

        def tallies(batches: Iterator[pa.RecordBatch], files=files) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
            for batch in batches:
                x = matrix(batch.column(0), parts * width).reshape(-1, parts, width)
                for p, file in enumerate(files):
                    index, _, _ = file.nearest(x[:, p])
                    np.add.at(sums[p], index, x[:, p])
                    counts[p] += np.bincount(index, minlength=entries)
            p, e = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

        told = rows.select("x").mapInArrow(tallies, "part long, entry long, n long, sums array<long>")
        totals = told.select("part", "entry", "n", F.posexplode("sums").alias("place", "s")).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        books = books.copy()
        for r in totals.collect():
            books[r.part, r.entry, r.place] = r.s // r.n
    return books


def codebooks_sha256(books: np.ndarray) -> str:
    """Of all entries' numbers in decimal by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(frame: DataFrame, vector: str = "embedding", key: str = "vec_id", carry: list[str] | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, bits: int = BITS) -> tuple[DataFrame, np.ndarray]:
    """key, the columns to carry, code (two hexadecimal digits for each part) and error (the parts' squared distances to
    their entries, summed) of every vector that can be compared; and the codebooks: parts by entries by places."""
    if not 1 <= entries <= 256:
        raise ValueError("an index of two digits knows 1 to 256 entries")
    carry = carry or []
    given = frame.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)), F.col(vector).alias("_vector")).where(is_finite_vector(F.col("_vector")))
    longest = given.agg(F.max(F.size("_vector"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    rows = given.withColumn("x", in_steps(F.col("_vector"), parts * width)).drop("_vector")
    first = rows.orderBy(F.col("_key").asc_nulls_last(), "x").limit(entries).select("x").collect()
    books = np.array([r.x for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    if len(first):
        books = train(rows, books, rounds, bits)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [VAFile(b, bits) for b in books]
        for batch in batches:
            x = matrix(batch.column(batch.num_columns - 1), parts * width).reshape(-1, parts, width)
            codes, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p, file in enumerate(files):
                codes[:, p], distance, _ = file.nearest(x[:, p])
                error += distance
            digits = codes.tobytes().hex()
            code = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(code, pa.string()), pa.array(error)], [*batch.schema.names[:-1], "code", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "x")
    out = rows.mapInArrow(assigned, f"{kinds}, code string, error long")
    return out.select(F.col("_key").alias(key), *(F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)), "code", "error"), books


def error_by(coded: DataFrame, label: str, to: str = "label_error") -> DataFrame:
    """coded with the sum of error over all rows of a label, nulls together. Sums are made before anything is shuffled, and
    joined as a table of one row for each label, so that a label of a third of all rows is no task of its own."""
    told = staged(coded, "codes")
    sums = staged(told.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias(to)), "label-errors")
    return told.join(sums, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")
