"""N-gram Jaccard join by prefix trees.

A document's set holds the 64-bit hashes of its distinct word n-grams, in one order for all documents: rare ones first, by
hash, then those found very often, by frequency. Two sets can only be similar enough if they share an n-gram among their
first ones (the prefix), so the sets that share one are candidates of each other. Sets of candidates are stored in a tree in
which common beginnings are one path; all sets go down the tree together, an overlap with a path counts for every set
below it, and a subtree is left as soon as the lengths that remain can't reach the threshold. Links are exact: similarities
are compared as integers.

Equal sets become one node first. Members of a small group are held against each other by their prefixes alone, in a tree of
prefixes: what two prefixes share, and what lies behind them at most, leaves few pairs. These pairs, and the n-grams of large
groups, make families, the components of candidates. Only sets in families are made in full. A family that fits a block is
joined in one tree. In a larger one every set is compared with a few hubs; what the hubs don't unite is joined in blocks, two
blocks in a tree, so no task holds a family, and pairs that are in one component already are left out. In full joins no
pairs are listed but links, and of these only such as unite two components of a task.

Defined cases: a null or empty text has an empty set and links with nothing; a text of fewer words than n has one n-gram, all
of it; repeated rows, and rows of the same id, are documents of their own and share their set's component; a component
is known by its least id; null ids come last there; an empty table gives an empty result; other columns are left out.
Two different n-grams count as one if their 64-bit hashes agree, by chance once in 2^64 pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm.common import id_key, in_shuffle, ship, sieve, staged, unstage
from tesserae.llm.graph import components

ship(__name__)

WORDS, PERCENT = 4, 85
#: Members of a group that is joined by prefixes; those of one whose members are weighed against each other first; hubs of a
#: family; members of a block; n-grams that are put last, at most.
SMALL, CLOSE, HUBS, BLOCK, FREQUENT = 64, 16, 4, 512, 1 << 20
#: Words whose hash a worker remembers; n-grams that it counts before it hands them on.
CACHE, HELD = 200_000, 2_500_000
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        got = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE:
            self[word] = got
        return got


def ngrams(text: bytes | None, known: WordHash, n: int) -> np.ndarray:
    """The distinct n-grams' hashes, ascending. bytes.lower() and split() know ASCII only."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(n, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        out = (out ^ h[i : len(h) - size + 1 + i]) * MIX[0]
        out ^= out >> np.uint64(29)
    out = (out ^ (out >> np.uint64(30))) * MIX[1]
    out = (out ^ (out >> np.uint64(27))) * MIX[2]
    return np.unique(out ^ (out >> np.uint64(31)))


def texts_in(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), signed(np.concatenate(rows) if rows else np.empty(0, np.uint64)))


def repeated(n: int):
    """N-grams that a task meets more than once, with counts. They only decide the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = WordHash(), [], 0

        def hand_on() -> pa.RecordBatch:
            grams, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([signed(grams[times > 1]), pa.array(times[times > 1])], ["gram", "c"])

        for batch in batches:
            for text in texts_in(batch, "_text"):
                own = ngrams(text, known, n)
                held.append(own)
                size += len(own)
                if size > HELD:
                    yield hand_on()
                    held, size = [], 0
        if held:
            yield hand_on()

    return run


def prefix_of(grams: np.ndarray, frequent: np.ndarray, rank: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The first n-grams of a set in the order that all share, and how many of them are not among the frequent."""
    size = len(grams)
    length = size - -(-percent * size // 100) + 1 if size else 0
    at = np.searchsorted(frequent, grams)
    late = np.zeros(size, bool)
    inside = at < len(frequent)
    late[inside] = frequent[at[inside]] == grams[inside]
    first = grams[~late][:length]
    rare = len(first)
    if rare < length:
        last = np.flatnonzero(late)
        last = last[np.argsort(rank[at[last]], kind="stable")]
        first = np.concatenate([first, grams[last[: length - rare]]])
    return first, rare


SETS = "rid long, n int, h1 long, h2 long, rare int, prefix array<long>"


def described(frequent: np.ndarray, rank: np.ndarray, n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rid = WordHash(), TaskContext.get().partitionId() << 40
        for batch in batches:
            sets = [ngrams(x, known, n) for x in texts_in(batch, "_text")]
            ids = np.arange(rid, rid + len(sets))
            rid += len(sets)
            marks = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets], np.uint64).reshape(-1, 2)
            firsts = [prefix_of(s, frequent, rank, percent) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_mark"), pa.array(ids), pa.array([len(s) for s in sets], pa.int32()), signed(marks[:, 0]), signed(marks[:, 1]), pa.array([x[1] for x in firsts], pa.int32()), lists([x[0] for x in firsts])], ["_key", "_mark", "rid", "n", "h1", "h2", "rare", "prefix"])

    return run


def full_sets(n: int):
    """family, node and its n-grams, for rows whose text has the node's set; another row may bear the same id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
            sets = [ngrams(x, known, n) for x in texts_in(batch, "_text")]
            h1, h2 = (batch.column(c).to_pylist() for c in ("h1", "h2"))
            same = [i for i, s in enumerate(sets) if divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) == (h1[i] % (1 << 64), h2[i] % (1 << 64))]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(same, pa.int64())) for c in ("family", "node")] + [lists([sets[i] for i in same])], ["family", "node", "grams"])

    return run


def linked(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


class Union(dict):
    def find(self, x: int) -> int:
        while self.setdefault(x, x) != x:
            self[x] = x = self[self[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)
        return a != b


def upper(n: np.ndarray, d: int) -> np.ndarray:
    return -(-n // d)


class Exact:
    """What two sets must share: 100 * both >= percent * (a + b - both)."""

    def __init__(self, percent: int):
        self.percent = percent

    def least(self, own: np.ndarray, low: int, high: int) -> np.ndarray:
        """What a set must share at least with one of a size from low to high."""
        return upper(self.percent * (own + low), 100 + self.percent)

    def pairs(self, own: np.ndarray, other: int) -> np.ndarray:
        return self.least(own, other, other)


class OfPrefixes(Exact):
    """What two prefixes must share. All that sets share and prefixes don't lies behind one of the prefixes."""

    def least(self, own: np.ndarray, low: int, high: int) -> np.ndarray:
        # Sizes that are too far from a set's own can't be its partners', so they don't count.
        low, high = np.maximum(upper(self.percent * own, 100), low), np.minimum(100 * own // self.percent, high)
        behind = upper(self.percent * np.maximum(own, high), 100) - 1
        return np.where(low <= high, upper(self.percent * (own + low), 100 + self.percent) - behind, 1 << 60)


def tree_join(nodes: list[int], labels: list[int], sets: list[np.ndarray], sizes: np.ndarray, rule: Exact, block: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that unite the members' components by the rule; by prefixes, all pairs. sizes: of the whole sets. With block (of
    each member), only pairs of different blocks are compared.

    The members' n-grams, the most common first, are stored in a tree whose edges are runs of n-grams. Going down, a run is
    held against all members still in play at once.
    """
    union, out, lengths = Union(), [], np.array([len(s) for s in sets])
    every = isinstance(rule, OfPrefixes)
    flat, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(flat), np.int64)
    place[np.lexsort((flat, -times))] = np.arange(len(flat))
    shared = int((times > 1).sum())  # n-grams behind these are in one set only and overlap with nothing
    ends = np.cumsum(lengths)
    ordered = [np.sort(place[inverse[e - s : e]]) for s, e in zip(lengths, ends)]
    ordered = [x[: np.searchsorted(x, shared)] for x in ordered]
    has = np.zeros((len(sets), shared), bool)
    for i, x in enumerate(ordered):
        has[i, x] = True
    group = None if block is None else np.array(block)
    order = sorted(range(len(sets)), key=lambda i: ordered[i].tolist())
    # A range of sets in this order with equal beginnings is a node of the tree.
    stack = [(0, len(order), 0, np.arange(len(sets)), np.zeros(len(sets), np.int64))]
    while stack:
        lo, hi, depth, alive, overlap = stack.pop()
        first, last = ordered[order[lo]], ordered[order[hi - 1]]
        run = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:run] != last[depth:run])
        end = depth + int(differ[0]) if len(differ) else run
        below = np.array(order[lo:hi])
        overlap = overlap + has[np.ix_(alive, first[depth:end])].sum(1)
        # The most that any set below can still share with each member in play.
        remain = max(len(ordered[i]) for i in below.tolist()) - end
        keep = np.minimum(overlap + remain, lengths[alive]) >= rule.least(sizes[alive], int(sizes[below].min()), int(sizes[below].max()))
        alive, overlap = alive[keep], overlap[keep]
        if not len(alive):
            continue
        at = lo
        while at < hi and len(ordered[order[at]]) == end:
            leaf = order[at]
            ok = (overlap >= rule.pairs(sizes[alive], int(sizes[leaf]))) & (alive != leaf)
            if every:  # once for a pair, and only if one could be most of the other
                ok &= alive > leaf
            if group is not None:
                ok &= group[alive] != group[leaf]
            for i in alive[ok].tolist():
                if every or union.join(labels[i], labels[leaf]):
                    out.append((nodes[i], nodes[leaf]))
            at += 1
        while at < hi:
            start, head = at, ordered[order[at]][end]
            while at < hi and ordered[order[at]][end] == head:
                at += 1
            stack.append((start, at, end, alive, overlap))
    return out


def by_group(names: list[str], rule: Exact, label: str = "node", block: str | None = None, size: str | None = None):
    """The tree join of each group of rows; rows come sorted by the group's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def join() -> None:
            nodes, labels, blocks, sizes, sets = zip(*held)
            if len(set(labels)) > 1:
                out.extend(tree_join(list(nodes), list(labels), list(sets), np.array(sizes), rule, list(blocks) if len(set(blocks)) > 1 else None))

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in names)))
            nodes, labels = batch.column("node").to_pylist(), batch.column(label).to_pylist()
            blocks = batch.column(block).to_pylist() if block else [0] * len(keys)
            grams = batch.column("grams")
            ends, values = grams.offsets.to_numpy(), grams.values.to_numpy()
            values = values.view(f"u{values.itemsize}")
            sizes = batch.column(size).to_pylist() if size else np.diff(ends).tolist()
            for i, k in enumerate(keys):
                if k != key and held:
                    join()
                    held = []
                key = k
                held.append((nodes[i], labels[i], blocks[i], sizes[i], values[ends[i] : ends[i + 1]].copy()))
            if len(out) > 10_000:
                yield pairs(out)
                out = []
        if held:
            join()
        yield pairs(out)

    return run


def chained(first, second):
    return lambda batches: second(first(batches))


def pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])


def against_hubs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, grams, hubs in zip(batch.column("node").to_pylist(), batch.column("grams"), batch.column("hubs")):
                own = grams.values.to_numpy()
                for hub in hubs:
                    other = hub["grams"].values.to_numpy()
                    small, large = sorted((len(own), len(other)))
                    if 100 * small >= percent * large and linked(len(own), len(other), len(np.intersect1d(own, other, assume_unique=True)), percent):
                        out.append((node, hub["node"].as_py()))
            yield pairs([x for x in out if x[0] != x[1]])

    return run


def with_partner(could) -> Column:
    """Of the members l of a list, those that could link with another of them; of long lists all."""
    return F.when(F.size("l") > CLOSE, F.col("l")).otherwise(F.filter("l", lambda x: F.exists("l", lambda y: (x["node"] != y["node"]) & could(x, y))))


def by_place(percent: int):
    """Whether two sets could link if this n-gram is the first that they share, at their places in the order: what comes from
    here on must be enough. Each pair that links passes in the list of the first n-gram that it shares."""
    return lambda x, y: (100 + percent) * F.least(x["n"] - x["at"], y["n"] - y["at"]).cast("long") >= percent * (x["n"].cast("long") + y["n"])


def by_shared(percent: int):
    """Whether two sets could link by their sizes n, and by how many n-grams of their prefixes (m) others share at all."""

    def could(x: Column, y: Column) -> Column:
        both, large = x["n"].cast("long") + y["n"], F.greatest(x["n"], y["n"]).cast("long")
        near = 100 * F.least(x["n"], y["n"]).cast("long") >= percent * large
        return near & (100 * (100 + percent) * F.least(x["m"], y["m"]).cast("long") > 100 * percent * both - percent * (100 + percent) * large)

    return could


def listed(postings: DataFrame, *keys: str) -> DataFrame:
    """keys, alone, least, l: the members of each group of postings. In a group of too many, each member (alone) has a row of
    its own, with the least of the group."""
    group = W.partitionBy(*keys)
    met = postings.withColumns({"m": F.count("*").over(group), "least": F.min("node").over(group)}).where("m > 1")
    alone = F.when(F.col("m") > SMALL, F.col("node")).otherwise(-1)
    return met.groupBy(*keys, alone.alias("alone")).agg(F.min("least").alias("least"), F.collect_list(F.struct("node", "n", "at")).alias("l"))


def candidates(sets: DataFrame, percent: int) -> DataFrame:
    """a, b: edges whose components hold all links. sets: node, n, rare, prefix, a row for each node."""
    postings = sets.select("node", "n", "rare", F.posexplode("prefix").alias("at", "gram"))
    # Frequent n-grams are as many as the order knows at most; what they need is aggregated before it is shuffled.
    late = postings.where("at >= rare").drop("rare")
    hot = staged(late.groupBy("gram").agg(F.min("node").alias("least"), F.count("*").alias("m")).where("m > 1"), "hot")
    led = late.join(F.broadcast(hot.where(F.col("m") > SMALL)), "gram")
    few = late.join(F.broadcast(hot.where(F.col("m") <= SMALL).select("gram")), "gram", "left_semi")
    shared = staged(listed(postings.where("at < rare").drop("rare").unionByName(few), "gram"), "shared")
    # N-grams of many nodes which the order didn't know: sets that link differ in size by a class at most, so each node
    # stands in the list of its own class and of the next.
    width = max(1.0001 * math.log(100 / percent), 1e-3)
    own_class = F.floor(F.log("n") / width).cast("int")
    many = shared.where("alone >= 0").select("gram", F.explode("l").alias("x")).select("gram", "x.*")
    classes = staged(listed(many.withColumn("class", F.explode(F.array(own_class, own_class + 1))), "gram", "class"), "classes")

    # Each list of members once.
    members = shared.where("alone < 0").select("l").union(classes.where("alone < 0").select("l")).withColumn("l", with_partner(by_place(percent))).select(F.array_sort(F.transform("l", lambda x: x["node"])).alias("members")).where("size(members) > 1")
    members = staged(members.distinct().select(F.xxhash64("members").alias("g1"), F.hash("members").alias("g2"), F.explode("members").alias("node")), "lists")
    # What the prefixes of members share with any others. 32 bits do: n-grams taken for one another only add candidates.
    own = shared.select("gram", F.explode("l").alias("x")).select("x.node", "x.n", "gram").union(led.select("node", "n", "gram"))
    own = sieve(own, members, ["node"]).where("_maybe").select("node", "n", F.hash("gram").alias("gram"))
    own = staged(own.groupBy("node").agg(F.first("n").alias("n"), F.collect_list("gram").alias("grams")), "own")
    weighed = members.join(in_shuffle(own.select("node", "n", F.size("grams").alias("m"))), "node").groupBy("g1", "g2").agg(F.collect_list(F.struct("node", "n", "m")).alias("l"))
    left = weighed.select("g1", "g2", F.explode(with_partner(by_shared(percent))).alias("x")).select("g1", "g2", "x.node")
    near = left.join(in_shuffle(own), "node").repartition("g1", "g2").sortWithinPartitions("g1", "g2", "node").mapInArrow(by_group(["g1", "g2"], OfPrefixes(percent), size="n"), "a long, b long")
    # An n-gram of many nodes, of one class, leads from each to the least of them.
    leads = led.select("node", "least").union(classes.where("alone >= 0").select("alone", "least")).where("node <> least")
    found = staged(near.union(leads).distinct(), "candidates")
    unstage(hot, shared, classes, members, own)
    return found


def jaccard_links(rows: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """rows: _key, _text, _mark. The described rows with their node, and links that unite all components of nodes."""
    kind = rows.schema["_key"].dataType.simpleString()
    counted = rows.select("_text").mapInArrow(repeated(n), "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c")).where(F.col("c") > SMALL)
    top = counted.orderBy(F.desc("c"), "gram").limit(FREQUENT).toArrow()
    grams, times = top["gram"].to_numpy().view(np.uint64), top["c"].to_numpy()
    rank = np.empty(len(grams), np.int64)
    rank[np.lexsort((grams, times))] = np.arange(len(grams))
    by_gram = np.argsort(grams)
    sets = staged(rows.mapInArrow(described(grams[by_gram], rank[by_gram], n, percent), f"_key {kind}, _mark long, {SETS}"), "sets")

    # Sets that occur once are nodes by themselves; only the others are looked up, in a table that is written, so that its
    # true size decides how, and a set of very many rows can be split.
    twice = staged(sets.where("n > 0").groupBy("h1", "h2").agg(F.min("rid").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"), "twice")
    owned = sets.join(twice, ["h1", "h2"], "left").withColumn("node", F.when(F.col("n") > 0, F.coalesce("first", "rid"))).drop("first")
    owned = staged(owned.withColumn("prefix", F.when(F.col("rid") == F.col("node"), F.col("prefix"))), "nodes")
    unstage(sets, twice)
    first = owned.where("rid = node")
    near = candidates(first.select("node", "n", "rare", "prefix"), percent)
    family = components(near).select("node", F.col("label").alias("family"))
    family = staged(family.join(in_shuffle(family.groupBy("family").agg(F.count("*").alias("members"))), "family"), "families")
    unstage(near)

    # The texts of families. Both sides grow with the corpus, so neither is broadcast even where it is still small enough;
    # the sieve keeps texts of no family out of the shuffle. Rows that are alike in id and text are one.
    wanted = staged(first.join(in_shuffle(family), "node").select(id_key(F.col("_key")).alias("_id"), "_mark", "node", "family", "members", "h1", "h2"), "wanted")
    bare = sieve(rows.select(id_key(F.col("_key")).alias("_id"), "_mark", "_text"), wanted, ["_id", "_mark"]).where("_maybe").drop("_maybe")
    alike = W.partitionBy("_id", "_mark").orderBy("_id")
    bare = bare.withColumn("_nth", F.row_number().over(alike)).where("_nth = 1").drop("_nth")
    texts = staged(bare.join(in_shuffle(wanted), ["_id", "_mark"]).drop("_id", "_mark"), "texts")
    exact, pair, made = Exact(percent), "a long, b long", full_sets(n)
    fits = texts.where(F.col("members") <= BLOCK).repartition("family").sortWithinPartitions("family", "node")
    links = staged(fits.mapInArrow(chained(made, by_group(["family"], exact)), pair), "links")
    unstage(wanted)

    family = family.where(F.col("members") > BLOCK).select("family", "node")
    if family.limit(1).count():
        full = staged(texts.where(F.col("members") > BLOCK).mapInArrow(made, "family long, node long, grams array<long>"), "full-sets")
        hub = family.withColumn("r", F.row_number().over(W.partitionBy("family").orderBy(F.xxhash64("node"), "node"))).where(F.col("r") <= HUBS)
        hubs = hub.select("node").join(full, "node").groupBy("family").agg(F.collect_list(F.struct("node", "grams")).alias("hubs"))
        star = full.join(hubs, "family").select("node", "grams", "hubs").mapInArrow(against_hubs(percent), pair)
        links = staged(links.union(star), "links")
        so_far = components(links)
        labelled = family.join(in_shuffle(so_far), "node", "left").select("family", "node", F.coalesce("label", "node").alias("label"))
        # A family that is one component needs no more. In others, all but the largest component meet everything.
        sizes = labelled.groupBy("family", "label").agg(F.count("*").alias("c"))
        main = sizes.groupBy("family").agg(F.max(F.struct("c", "label"))["label"].alias("main"), F.count("*").alias("parts"), F.sum("c").alias("all"), (F.sum("c") - F.max("c")).alias("rest"))
        rest = labelled.join(main.where("parts > 1"), "family").withColumn("outer", F.col("label") != F.col("main"))
        rest = rest.withColumns({"outer_blocks": F.ceil(F.col("rest") / BLOCK).cast("int"), "inner_blocks": F.ceil((F.col("all") - F.col("rest")) / BLOCK).cast("int")})
        rest = staged(rest.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("outer"), F.col("outer_blocks")).otherwise(F.col("inner_blocks"))).cast("int")).select("family", "node", "label", "outer", "own", "outer_blocks", "inner_blocks"), "rest")
        # Outer blocks are numbered from 0, inner ones behind them. An outer block meets every other; inner ones don't meet.
        others = F.when(F.col("outer"), F.sequence(F.lit(0), F.col("outer_blocks") + F.col("inner_blocks") - 1)).otherwise(F.sequence(F.lit(0), F.col("outer_blocks") - 1))
        block = F.when(F.col("outer"), F.col("own")).otherwise(F.col("own") + F.col("outer_blocks"))
        dealt = rest.withColumn("block", block).withColumn("other", F.explode(others))
        dealt = dealt.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label")
        dealt = dealt.join(in_shuffle(full.select("node", "grams")), "node").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "node")
        links = staged(links.union(dealt.mapInArrow(by_group(["family", "i", "j"], exact, "label", "block"), pair)), "links")
        unstage(full, rest)
    unstage(texts)
    return owned, links


def jaccard_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """key, mark (the text's hash), n_shingles, component_id and head of every row; head: the one row that stands for its
    component, by the least id. Linked: 100 * intersection >= percent * union."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(text).alias("_mark"))
    owned, links = jaccard_links(rows, n, percent)
    labelled = owned.join(in_shuffle(components(links)), "node", "left").withColumn("class", F.coalesce("label", "node"))
    # Written before it is joined, so that a class of very many rows can be split there.
    least = staged(labelled.where("class IS NOT NULL").groupBy(F.col("class").alias("c")).agg(F.min(F.struct(F.col("_key").isNull().alias("x"), "_key", "rid")).alias("l")), "classes")
    out = labelled.join(in_shuffle(least), labelled["class"] == least["c"], "left")
    component = F.when(F.col("class").isNull(), F.col("_key")).otherwise(F.col("l._key"))
    head = F.col("class").isNull() | (F.col("rid") == F.col("l.rid"))
    return out.select(F.col("_key").alias(key), F.col("_mark").alias("mark"), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), head.alias("head"))


def jaccard_components(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """key, n_shingles and component_id of every row."""
    return jaccard_groups(docs, text, key, n, percent).select(key, "n_shingles", "component_id")
