"""Packing of documents into sequences of bounded length, by bounded-space online best-fit.

Texts are cut into ids, a document's ids are closed by an end, and only a document longer than a sequence is cut into pieces.
Pieces come in an order that is random and the same on every run, and so many at a time wait to go longest first, for long
pieces need bins while there is much left to fill them up. So many bins are open at most; a bitset has a bit for each
free space that an open bin has, so that the smallest that is large enough is found by one shift. Where none is, a bin is
opened, and if there are as many as may be, the fullest is closed first. A full bin is closed at once.

Pieces are dealt to groups by the hash of a row number, so that no key, length or text makes a large group; a group is as many
sequences that what its open bins leave at its end is a small part of a percent. The table of pieces is written once to the
shared folder, without texts, and only what the caller asks for travels: lengths and hashes, or the ids too.

Defined cases: a null or empty text is its end alone; rows that are alike are documents of their own; an empty table gives
none. Special tokens that stand in a text are ids of their own, as the tokenizer has it. A text is cut into ids in stretches
that end before white space, which no token crosses; a stretch without white space is cut as a whole. Columns called
sequence_id and offset are replaced.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesserae.llm.common import ship, staged

ship(__name__)

#: Tokens of a sequence; the id that ends a document; bins that are open at once.
CAPACITY, END, OPEN = 4096, 1, 1024
#: Pieces that wait at a time.
WAITING = 4096
#: Tokens of a group, and most groups.
GROUP, GROUPS = 1 << 26, 1 << 16
#: Characters that are cut into ids at once, about; words that a worker remembers, and their longest.
STRETCH, REMEMBERED, LONGEST = 1 << 20, 1 << 19, 64

#: What a tokenizer's file says where its words can be told apart beforehand, and its words' end.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

#: The same in lower case among the first 256 characters, which no normal form changes and whose classes are settled.
LETTERS, NUMBERS, BLANKS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
PLAIN = re.compile(f"'(?:[stmd]|re|ve|ll)|[{LETTERS}]+|[{NUMBERS}]|[^{BLANKS}{LETTERS}{NUMBERS}]+")
BETWEEN_BLANKS, BLANK = re.compile(r"[^ \t\n\r]+"), re.compile(r"[ \t\n\r]")


class Codec:
    """Cuts texts into ids as the tokenizer does, and remembers words.

    Where the file has the normalizers and words above, a text without other characters than the first 256 is cut into words
    here, and each word is looked up or, together with others that aren't known, given to the tokenizer. Of any other text
    this goes for what stands between blanks. Another file's texts go to the tokenizer whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        split = [x for x in (said.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"]
        normal = (said.get("normalizer") or {}).get("normalizers")
        self.by_words = normal == NORMALIZERS and [x["pattern"] for x in split] == [{"Regex": WORDS}] and said["model"].get("end_of_word_suffix") == WORD_END
        self.specials = [x["content"] for x in said["added_tokens"]]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(WORD_END)]] = True
        self.known: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Remember the ids of words, as little-endian unsigned 32-bit integers."""
        common, other = [], []
        for w in words:
            (common if plain(w) and PLAIN.fullmatch(w) else other).append(w)
        for a in range(0, len(common), 4096):
            # A word's last token ends a word, and no other of its tokens does.
            some = common[a : a + 4096]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
            body = ids.tobytes()
            self.known.update(zip(some, (body[i:j] for i, j in pairwise(ends)), strict=True))
        for w, e in zip(other, self.tokenizer.encode_batch(other, add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, "<u4").tobytes()

    def words(self, text: str) -> list[str]:
        special = any(s in text for s in self.specials)
        if not special and plain(text):
            return PLAIN.findall(text.lower())
        out = []
        for w in BETWEEN_BLANKS.findall(text):
            if plain(w) and not (special and any(s in w for s in self.specials)):
                out += PLAIN.findall(w.lower())
            else:
                out.append(w)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Memory is bounded by a stretch beside the ids, for texts with white space in them."""
        if not self.by_words:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        size = 0

        def look_up() -> None:
            asked = {w for _, words in waiting for w in words}
            new = asked.difference(self.known)
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = asked
            self.learn(sorted(new))
            for i, words in waiting:
                out[i].append(b"".join(map(self.known.__getitem__, words)))
            for w in new:
                if len(w) > LONGEST:
                    del self.known[w]
            waiting.clear()

        for i, text in enumerate(texts):
            at = 0
            while at < len(text):
                cut = BLANK.search(text, at + STRETCH)
                to = cut.start() if cut else len(text)
                waiting.append((i, self.words(text[at:to])))
                size, at = size + to - at, to
                if size >= STRETCH:
                    look_up()
                    size = 0
        look_up()
        return [b"".join(parts) for parts in out]


@lru_cache(maxsize=1)
def codec_of(path: str) -> Codec:
    """The codec of this process, with the words that it remembers."""
    return Codec(path)


def plain(text: str) -> bool:
    """Whether a text has only the first 256 characters."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def pieces(docs: DataFrame, path: str, text: str | Column = "text", key: str = "doc_id", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """key, piece (from 0), start, length, ids_crc32 of each document's ids and the end, and with_ids the ids as bytes.

    path: the tokenizer's file, which every worker must be able to read. Nothing is shuffled.
    """
    frame = docs.select(F.col(key).alias("_key"), (F.col(text) if isinstance(text, str) else text).alias("_text"))
    kind = frame.schema["_key"].dataType.simpleString()
    closing, width = np.array([end], "<u4").tobytes(), 4 * capacity

    def cut(keys: pa.Array, texts: list[str], codec: Codec) -> pa.RecordBatch:
        rows, numbers, bodies = [], [], []
        for i, ids in enumerate(codec.encode(texts)):
            ids += closing
            for a in range(0, len(ids), width):
                body = ids[a : a + width]
                rows.append(i)
                numbers.append((a // width, a // 4, len(body) // 4, zlib.crc32(body)))
                bodies.append(body)
        columns = [pa.array(c, t) for c, t in zip(zip(*numbers), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
        names = ["_key", "piece", "start", "length", "ids_crc32"]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), *columns, *([pa.array(bodies, pa.binary())] if with_ids else [])], [*names, *(["ids"] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Where workers have this package, one codec serves all tasks of a worker; else each task has its own.
        try:
            from tesserae.llm.packing import codec_of as own
        except ModuleNotFoundError:
            own = Codec
        codec = own(path)
        for batch in batches:
            texts, size, first = [], 0, 0
            for i, x in enumerate(batch.column(1)):
                texts.append(x.as_py() or "")
                size += len(texts[-1])
                if size >= STRETCH or i + 1 == batch.num_rows:
                    yield cut(batch.column(0).slice(first, len(texts)), texts, codec)
                    texts, size, first = [], 0, i + 1

    told = frame.mapInArrow(run, f"_key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)
    return told.withColumnRenamed("_key", key)


class Bins:
    """Bounded-space online best-fit. Pieces of one length after another get a bin and an offset."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN):
        self.capacity, self.most, self.made, self.open = capacity, most, 0, 0
        #: Bit f is set where a bin with f free is open; those bins, the last one put there first out.
        self.bits, self.free = 0, [[] for _ in range(capacity + 1)]

    def take(self, free: int) -> int:
        found = self.free[free].pop()
        if not self.free[free]:
            self.bits ^= 1 << free
        return found

    def put(self, length: int) -> tuple[int, int]:
        if not 1 <= length <= self.capacity:
            raise ValueError(f"a piece of {length} tokens does not go into a sequence of {self.capacity}")
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            found = self.take(free)
        else:
            if self.open == self.most:
                self.take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            free, found = self.capacity, self.made
            self.made += 1
            self.open += 1
        left = free - length
        if left:
            self.free[left].append(found)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return found, self.capacity - free


def pack(rows: DataFrame, capacity: int = CAPACITY, most_open: int = OPEN, length: str = "length", group: int = GROUP) -> DataFrame:
    """rows with the sequence_id that each goes to and its offset there; sequences are filled from 0 without gaps."""
    kept = rows.select(*(c for c in rows.columns if c not in ("sequence_id", "offset")))
    numbered = staged(kept.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    total = numbered.agg(F.sum(length)).first()[0] or 0
    groups = min(max(1, -(-total // group)), GROUPS)
    dealt = numbered.withColumn("_order", F.xxhash64("_row")).repartition(groups, "_order").sortWithinPartitions("_order", "_row").drop("_order", "_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, first = Bins(capacity, most_open), TaskContext.get().partitionId() << 40
        for batch in batches:
            lengths = batch.column(length).to_pylist()
            places: list[tuple[int, int]] = [(0, 0)] * len(lengths)
            for a in range(0, len(lengths), WAITING):
                for i in sorted(range(a, min(a + WAITING, len(lengths))), key=lambda i: -lengths[i]):
                    places[i] = bins.put(lengths[i])
            sequence, offset = zip(*places) if places else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(sequence, np.int64) + first), pa.array(offset, pa.int64())], [*batch.schema.names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return dealt.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """sequence_id, ids (bytes of all pieces in order) and starts: what a model is trained on. A sequence holds as many pieces
    as tokens at most."""
    order = F.sort_array(F.collect_list(F.struct("offset", F.col(ids).alias("ids"))))
    lists = packed.groupBy("sequence_id").agg(order.alias("p"))
    return lists.select("sequence_id", F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["ids"])).alias("ids"), F.transform("p", lambda x: x["offset"]).alias("starts"))
