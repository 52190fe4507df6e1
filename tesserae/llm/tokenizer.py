"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks that overlap. Each chunk is pre-tokenised alone, from its first character, which may lie within
a pre-token. Matching goes only forward, so from the first position at which two neighbouring chunks both begin a
pre-token their pre-tokens agree: there the chunks are stitched. Then the pieces are encoded, by joining neighbours of the
least rank, and decoding concatenates the bytes of the ids. Chunks are a few thousand characters long, so that any text of
some pages has several; those of very long texts are dealt out to many tasks.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to no bytes; a text whose chunks never
agree within the overlap (such as one long run of letters) is pre-tokenised on from the last sure boundary; repeated rows
give repeated results; columns other than the id and the text are left out of the result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm.common import ship, staged

ship(__name__)

#: Characters of a chunk that are its own, and by which it reaches into the next; characters of a chunk that is dealt out,
#: and of a text from which its chunks are.
CHUNK, OVERLAP, PART, LONG = 1 << 12, 1 << 9, 1 << 20, 1 << 22
#: Distinct pieces whose ids a worker remembers; bytes of a piece up to which its pairs are looked through for each merge.
CACHE, LISTED = 500_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def boundaries(pattern: regex.Pattern, text: str, start: int, end: int) -> list[int]:
    """Where the pre-tokens of text[start:end] begin, and end."""
    found = [m.start() for m in pattern.finditer(text, start, end)]
    return [*found, end]


def stitched(pattern: regex.Pattern, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[str]]:
    """The pre-tokens of text, a list for each stretch between two stitches."""
    size, k = len(text), 0
    if size <= chunk + overlap:
        yield pattern.findall(text)
        return
    mine = boundaries(pattern, text, 0, chunk + overlap)
    while True:
        begin = (k + 1) * chunk
        end = min(size, begin + chunk + overlap)
        last = k * chunk + chunk + overlap >= size
        if last:
            yield cut(text, mine)
            return
        following = boundaries(pattern, text, begin, end)
        # A token that touches the chunk's end could go on behind it; so could white space before one more.
        limit = mine[-3] if len(mine) > 2 else -1
        seen = set(following)
        meet = next((p for p in mine if begin <= p <= limit and p in seen), None)
        if meet is None:
            # From the last sure boundary the whole text is matched on, to the first token that begins behind this chunk: a
            # token that is longer than chunks is matched once, and the chunks within it are passed over.
            sure, on = max(limit, mine[0]), []
            for m in pattern.finditer(text, sure):
                on.append(m.start())
                if on[-1] >= begin:
                    break
            else:
                on.append(size)
            yield cut(text, [*(p for p in mine if p < sure), *on])
            if on[-1] == size:
                return
            k = on[-1] // chunk
            mine = boundaries(pattern, text, on[-1], min(size, (k + 1) * chunk + overlap))
            continue
        yield cut(text, [p for p in mine if p <= meet])
        mine, k = [p for p in following if p >= meet], k + 1


def cut(text: str, at: list[int]) -> list[str]:
    return [text[a:b] for a, b in zip(at, at[1:])]


NEVER = 1 << 40


def merged(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """The ids of a pre-token. Of all neighbours that together are a token, those of the least rank are joined first, the
    leftmost of equal ones; longest: the bytes of the longest token."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > LISTED:
        return merged_by_heap(piece, ranks, longest)
    get, parts = ranks.get, [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(piece[i : i + 2], NEVER) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) < NEVER:
        i = pairs.index(least)
        parts[i] += parts[i + 1]
        del parts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], NEVER)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], NEVER)
    return list(map(ranks.__getitem__, parts))


def merged_by_heap(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """The same, for pieces whose pairs are too many to look through for each merge."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins at each place, 0 where none begins any more
    before = list(range(-1, n - 1))  # where the part before begins
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)

    def offer(i: int, stop: int) -> None:
        if stop - i <= longest and (rank := ranks.get(piece[i:stop])) is not None:
            heappush(heap, (rank, i, stop))

    while heap:
        _, i, stop = heappop(heap)
        j = end[i]
        if not j or j == n or end[j] != stop:
            continue  # one of the two has been joined with another
        end[i], end[j] = stop, 0
        if before[i] >= 0:
            offer(before[i], stop)
        if stop < n:
            before[stop] = i
            offer(i, end[stop])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Pieces(dict):
    """The ids of pre-tokens as little-endian unsigned 32-bit integers; the first short ones it meets are remembered."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.longest = ranks, max(map(len, ranks), default=0)

    def __missing__(self, piece: str) -> bytes:
        ids = b"".join(i.to_bytes(4, "little") for i in merged(piece.encode(), self.ranks, self.longest))
        if len(piece) < 64 and len(self) < CACHE:
            self[piece] = ids
        return ids


class Codec:
    """Encodes pieces by ranks, and ids back to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern, self.known = regex.compile(pattern), Pieces(ranks)
        self.bytes_of = {v: k for k, v in ranks.items()}

    def encode(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.known.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(path: str, pattern: str, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(read_ranks(path), pattern)
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            n, ids_sha, out_sha, ids = [], [], [], []
            for text in batch.column(at):
                ids_of, out_of, count, kept = hashlib.sha256(), hashlib.sha256(), 0, []
                for pieces in stitched(codec.pattern, text.as_py() or ""):
                    got = codec.encode(pieces)
                    ids_of.update(got)
                    out_of.update(codec.decode(got))
                    count += len(got) // 4
                    if with_ids:
                        kept.append(got)
                n.append(count)
                ids_sha.append(ids_of.hexdigest())
                out_sha.append(out_of.hexdigest())
                ids.append(b"".join(kept))
            made = [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())]
            names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                made, names = [*made, pa.array(ids, pa.binary())], [*names, "ids"]
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in rest] + made, [batch.schema.names[i] for i in rest] + names)

    return run


def near_ends(pattern: str, chunk: int, overlap: int):
    """Of each chunk, the boundaries in its first characters that overlap, and in its last; places in the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        for batch in batches:
            heads, tails = [], []
            for k, text in zip(batch.column("k").to_pylist(), batch.column("part").to_pylist()):
                found = boundaries(compiled, text, 0, len(text))
                sure = found[-2] if len(found) > 1 else -1  # the last pre-token could go on behind the chunk
                heads.append([k * chunk + p for p in found if p <= overlap])
                tails.append([k * chunk + p for p in found if chunk <= p <= sure])
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("k"), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], ["rid", "k", "heads", "tails"])

    return run


def encoded_parts(path: str, pattern: str, chunk: int):
    """The ids of each chunk's own stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(read_ranks(path), pattern)
        for batch in batches:
            ids = []
            for k, text, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("k", "part", "lo", "hi"))):
                # Boundaries are the stretch's own: the pattern looks ahead, so the text goes on behind it.
                at = boundaries(codec.pattern, text, lo - k * chunk, len(text))
                ids.append(codec.encode(cut(text, [p for p in at if p <= hi - k * chunk])))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("rid"), batch.column("k"), pa.array(ids, pa.binary())], ["_key", "rid", "k", "ids"])

    return run


def put_together(path: str, pattern: str, with_ids: bool):
    """A row for each text from its parts, which come in order; hashes are fed part by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, rid, state = Codec(read_ranks(path), pattern), None, None

        def row() -> pa.RecordBatch:
            key, n, a, b, kept = state
            made = [key, pa.array([n], pa.int64()), pa.array([a.hexdigest()]), pa.array([b.hexdigest()])]
            names = ["_key", "n_tokens", "ids_sha256", "decoded_sha256"]
            return pa.RecordBatch.from_arrays(made + [pa.array([b"".join(kept)], pa.binary())] * with_ids, names + ["ids"] * with_ids)

        for batch in batches:
            for i, (r, ids) in enumerate(zip(batch.column("rid").to_pylist(), batch.column("ids").to_pylist())):
                if r != rid:
                    if state:
                        yield row()
                    rid, state = r, [batch.column("_key").slice(i, 1), 0, hashlib.sha256(), hashlib.sha256(), []]
                state[1] += len(ids) // 4
                state[2].update(ids)
                state[3].update(codec.decode(ids))
                if with_ids:
                    state[4].append(ids)
        if state:
            yield row()

    return run


def encode(docs: DataFrame, path: str, pattern: str, text: str | Column = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of every row, and with_ids the ids themselves as bytes.

    path: the rank file, which every worker must be able to read. Most texts are encoded where they are, and nothing is
    shuffled. The chunks of very long texts are dealt out: tasks pre-tokenise them, places where neighbours agree are found,
    tasks encode the stretches between, and the hashes run over these in order. A text with neighbours that don't agree
    within the overlap is encoded in one task.
    """
    frame = docs.select(F.col(key).alias("_key"), (F.col(text) if isinstance(text, str) else text).alias("_text"))
    kind = frame.schema["_key"].dataType.simpleString()
    schema = f"_key {kind}, {SCHEMA}" + ", ids binary" * with_ids
    size = F.coalesce(F.length("_text"), F.lit(0))
    if (frame.agg(F.max(size)).first()[0] or 0) <= LONG:
        return frame.mapInArrow(digests(path, pattern, with_ids), schema).withColumnRenamed("_key", key)

    short = frame.where(size <= LONG).mapInArrow(digests(path, pattern, with_ids), schema)
    long = frame.where(size > LONG).withColumn("rid", F.monotonically_increasing_id())
    dealt = long.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.length("_text") - 1) / PART))))
    dealt = staged(dealt.select("_key", "rid", "k", F.expr(f"substring(_text, CAST(k * {PART} + 1 AS INT), {PART + OVERLAP})").alias("part")), "chunks").repartition("rid", "k")
    ends = staged(dealt.select("rid", "k", "part").mapInArrow(near_ends(pattern, PART, OVERLAP), "rid long, k long, heads array<long>, tails array<long>"), "ends")
    order = W.partitionBy("rid").orderBy("k")
    met = ends.withColumns({"hi": F.array_min(F.array_intersect("tails", F.lead("heads").over(order))), "last": F.lead("k").over(order).isNull()})
    met = met.withColumns({"lo": F.lag("hi").over(order), "apart": F.max(F.col("hi").isNull() & ~F.col("last")).over(W.partitionBy("rid"))})
    met = met.select("rid", "k", "apart", F.coalesce("lo", F.lit(0)).alias("lo"), F.coalesce("hi", F.lit(1 << 60)).alias("hi"))
    parts = dealt.join(met.where("NOT apart").drop("apart"), ["rid", "k"]).select("_key", "rid", "k", "part", "lo", "hi")
    ids = parts.mapInArrow(encoded_parts(path, pattern, PART), f"_key {kind}, rid long, k long, ids binary")
    whole = ids.repartition("rid").sortWithinPartitions("rid", "k").mapInArrow(put_together(path, pattern, with_ids), schema)
    apart = dealt.join(met.where("apart").select("rid").distinct(), "rid").groupBy("rid").agg(F.first("_key").alias("_key"), F.sort_array(F.collect_list(F.struct("k", F.expr(f"substring(part, 1, {PART})").alias("p")))).alias("parts"))
    rest = apart.select("_key", F.array_join(F.transform("parts", lambda x: x["p"]), "").alias("_text")).mapInArrow(digests(path, pattern, with_ids), schema)
    return short.union(whole).union(rest).withColumnRenamed("_key", key)


def decode(frame: DataFrame, path: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """The texts whose ids (as bytes, from encode()) are in a column; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {v: k for k, v in read_ranks(path).items()}
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            texts = [None if x.as_py() is None else b"".join(map(table.__getitem__, memoryview(x.as_py()).cast("I"))).decode() for x in batch.column(at)]
            yield batch.append_column(to, pa.array(texts, pa.string()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return frame.mapInArrow(run, f"{kinds}, `{to}` string")
