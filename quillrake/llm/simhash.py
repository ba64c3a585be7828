"""SimHash fingerprints and near-duplicate groups through vantage-point trees.

Equal fingerprints are collapsed first, so groups of copies cost one entry. A vantage-point tree over a bounded sample
deals the distinct fingerprints into shards: a fingerprint lives in one leaf and also queries each leaf whose ball the
triangle bounds cannot exclude, from the outer side to the inner side of each boundary only, so each pair meets at
least once. Inside a shard the same split recurses on the shard's own fingerprints and small leaves are compared in
blocks. Shards return a spanning forest of their links; components joins the forests on the cluster.

`near_duplicates` links 64-bit fingerprints of few differing bits. `one_each` keeps one row of each group of texts whose
sets of shingles have a Jaccard coefficient of 0.8 or more: longer fingerprints of the sets and a wide radius find
groups that may hold such pairs, sizes that rule a pair out are bounds of the tree beside distances, and full sets
decide the pairs within a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrake.llm.common import mix, slices, staged, string_bytes, utf8, word_hashes, word_places
from quillrake.llm.components import components

#: Leaves at most, fingerprints of the sample that shapes the tree for each leaf, and fingerprints a leaf aims at.
LEAVES, SAMPLE, LEAF = 16_384, 16, 6_000
#: Sides of a block that is compared without further splits.
BLOCK = 512
#: Bytes of texts of a group that one task checks alone, blocks that a larger group is dealt into while they hold no more
#: than BLOCK_BYTES each.
GROUP_BYTES, GROUP_BLOCKS, BLOCK_BYTES = 256_000, 16, 16_000_000
#: Bits of the map that tells rows apart which surely are not asked for: 8 MB, whatever the table.
MAP_BITS = 1 << 26
#: 64-bit words of a set's fingerprint, and the radius at which 99.8 of 100 pairs of a Jaccard coefficient of 0.8 link
#: (they differ in 29.1 of 192 bits on average, with a deviation of 5.0; unlike sets in 96, with one of 6.9).
SET_WORDS, SET_BITS = 3, 44

_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def majorities(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For consecutive runs of hashes (of these sizes, none empty): the bits that are set in over half of a run."""
    out, ends = np.empty(len(sizes), np.uint64), np.cumsum(sizes)
    first = 0
    while first < len(sizes):  # some 100,000 hashes at a time
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + 100_000, side="right")))
        out[first:last] = _majorities(h[ends[first] - sizes[first] : ends[last - 1]], sizes[first:last])
        first = last
    return out


def _majorities(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    # bits are counted in lanes of eight bits, so runs are cut into parts of 255 at most
    parts = -(-sizes // 255)
    part = np.repeat(np.cumsum(sizes) - sizes, parts) + 255 * (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts))
    counts = np.empty((len(part), 64), np.uint8)
    for byte in range(8):
        lanes = _LANES[(h >> np.uint64(8 * byte)).astype(np.uint8)]
        counts[:, 8 * byte : 8 * byte + 8] = np.add.reduceat(lanes, part).view(np.uint8).reshape(-1, 8)
    whole = np.add.reduceat(counts, np.cumsum(parts) - parts, axis=0, dtype=np.int64)
    return np.packbits(whole * 2 > sizes[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprint(text: bytes, seed: int = 42, size: int = 3) -> int:
    """The 64-bit SimHash of lower-cased (A-Z) words' shingles, repeats included; no words: 0."""
    h = _shingle_hashes(text, seed, size)
    return int(majorities(h, np.array([len(h)]))[0]) if len(h) else 0


def _shingle_hashes(text: bytes, seed: int, size: int) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n]
    ends = ends[min(size, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, n)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, size: int = 3) -> DataFrame:
    """(id, fingerprint as a signed long) for each row; null and wordless texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 2_000_000):
                found = [_shingle_hashes(t, seed, size) for t in utf8(part.column(1))]
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                prints = np.zeros(len(found), np.uint64)
                prints[sizes > 0] = majorities(np.concatenate(found), sizes[sizes > 0])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long").select(F.col("id").alias(id_col), "fp")


# ---- the tree that deals fingerprints into shards


class Prints:
    """Fingerprints of one or more 64-bit words, sizes of what they stand for, and when two of them link.

    They link at `bits` or fewer differing bits; with `least`, only if the smaller size is at least that part of the larger.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray | None, bits: int, least: float | None):
        self.words = words if words.ndim == 2 else words[:, None]
        self.sizes = np.ones(len(words), np.int64) if sizes is None else sizes
        self.bits, self.least = bits, least

    def distance(self, which: np.ndarray, vantage: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.words[which] ^ vantage).sum(axis=1, dtype=np.int64)

    def close(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of a and b that link, all compared."""
        x, y = self.words[a], self.words[b]
        d = np.bitwise_count(x[:, :1] ^ y[:, 0])
        for w in range(1, x.shape[1]):
            d += np.bitwise_count(x[:, w : w + 1] ^ y[:, w])
        i, j = np.nonzero(d <= self.bits)
        i, j = a[i], b[j]
        if self.least is not None:
            s, t = self.sizes[i], self.sizes[j]
            near = np.minimum(s, t) >= self.least * np.maximum(s, t)
            i, j = i[near], j[near]
        return i, j

    def split(self, which: np.ndarray, prunes: bool = False) -> tuple[np.ndarray, int] | None:
        """A vantage point and radius that halve the points well, or None where all tried leave them together.

        prunes: None also where nearly all points lie too near the boundary to be pruned.
        """
        best = None
        for i in np.linspace(0, len(which) - 1, 8).astype(int):
            d = self.distance(which, self.words[which[i]])
            for radius in {int(np.median(d)), int(np.median(d)) - 1}:
                inner = int((d <= radius).sum())
                edge = int(((d > radius) & (d <= radius + self.bits)).sum())
                if 0 < inner < len(which) and not (prunes and edge > 0.9 * (len(which) - inner)):
                    cost = max(inner, len(which) - inner) + edge
                    if best is None or cost < best[0]:
                        best = cost, self.words[which[i]], radius
        return best and best[1:]


def grow(sample: Prints, leaves: int) -> list:
    """The tree: nodes [vantage, radius, inner, outer], or [None, size, smaller, others] where sizes rule pairs out; a leaf is its number."""

    def build(which: np.ndarray, share: int):
        if share > 1 and len(which) > 8:
            sizes = sample.sizes[which]
            cut = int(np.median(sizes))
            if sample.least is not None and sizes.min() < cut and sizes.min() < sample.least**2 * sizes.max():
                return make(which, share, None, cut, sizes < cut)
            found = sample.split(which)
            if found is not None:
                return make(which, share, *found, sample.distance(which, found[0]) <= found[1])
        numbers.append(0)
        return len(numbers) - 1

    def make(which: np.ndarray, share: int, vantage, bound: int, inner: np.ndarray) -> list:
        half = min(share - 1, max(1, round(share * inner.mean())))
        return [vantage, bound, build(which[inner], half), build(which[~inner], share - half)]

    numbers: list[int] = []
    return build(np.arange(len(sample.words)), leaves)


def deal(tree, prints: Prints) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(leaf, places of fingerprints, do they live there?) over the tree."""

    def walk(node, own: np.ndarray, guests: np.ndarray):
        if isinstance(node, int):
            yield node, own, True
            yield node, guests, False
            return
        vantage, bound, inner, outer = node
        if vantage is None:
            s, g = prints.sizes[own], prints.sizes[guests]
            yield from walk(inner, own[s < bound], np.concatenate([guests[g * prints.least < bound], own[(s >= bound) & (s * prints.least < bound)]]))
            yield from walk(outer, own[s >= bound], guests[g >= bound * prints.least])
        else:
            d, g = prints.distance(own, vantage), prints.distance(guests, vantage)
            yield from walk(inner, own[d <= bound], np.concatenate([guests[g <= bound + prints.bits], own[(d > bound) & (d <= bound + prints.bits)]]))
            yield from walk(outer, own[d > bound], guests[g > bound - prints.bits])

    yield from walk(tree, np.arange(len(prints.words)), np.zeros(0, np.int64))


# ---- links inside a shard


class Forest:
    """Components of a shard's entries; labels stay compressed."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b, n = self.label[a], self.label[b], len(self.label)
        apart = np.unique((a * n + b)[a != b])
        if not len(apart):
            return
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for x, y in zip((apart // n).tolist(), (apart % n).tolist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        old = np.fromiter(up, np.int64, len(up))
        table = np.arange(len(self.label))
        table[old] = [root(x) for x in old.tolist()]
        self.label = table[self.label]

    def edges(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node, smallest node of its tree) where they differ."""
        least = np.full(len(nodes), np.iinfo(np.int64).max)
        np.minimum.at(least, self.label, nodes)
        to = least[self.label]
        keep = nodes != to
        return nodes[keep], to[keep]


class Meeting:
    """Compares fingerprints and hands the pairs that link, block by block, to `found`."""

    def __init__(self, prints: Prints, found):
        self.prints, self.found = prints, found

    def across(self, a: np.ndarray, b: np.ndarray) -> None:
        """Meets each of a with each of b, splitting by vantage points while both are large."""
        if not len(a) or not len(b):
            return
        found = self.prints.split(a, prunes=True) if len(a) > BLOCK and len(b) > BLOCK else None
        if found is None:
            self._blocks(a, b)
            return
        vantage, radius = found
        da, db, bits = self.prints.distance(a, vantage), self.prints.distance(b, vantage), self.prints.bits
        self.across(a[da <= radius], b[db <= radius + bits])
        self.across(a[da > radius], b[db > radius - bits])

    def _blocks(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a) > len(b):
            a, b = b, a
        least = self.prints.least
        if least is not None:
            a, b = (x[np.argsort(self.prints.sizes[x], kind="stable")] for x in (a, b))
            sizes = self.prints.sizes[b]
        for i in range(0, len(a), BLOCK):
            mine, first, last = a[i : i + BLOCK], 0, len(b)
            if least is not None:
                s = self.prints.sizes[mine]
                first, last = int(np.searchsorted(sizes, s[0] * least)), int(np.searchsorted(sizes, s[-1] / least, side="right"))
            step = max(1, (1 << 18) // len(mine))
            for j in range(first, last, step):
                self.found(*self.prints.close(mine, b[j : min(last, j + step)]))

    def within(self, own: np.ndarray) -> None:
        """Meets each of own with each other."""
        found = self.prints.split(own, prunes=True) if len(own) > BLOCK else None
        if found is None:
            own = own[np.argsort(self.prints.sizes[own], kind="stable")]
            for i in range(0, len(own), BLOCK):
                self._blocks(own[i : i + BLOCK], own[i:])
            return
        d, (_, radius), bits = self.prints.distance(own, found[0]), found, self.prints.bits
        inner, outer = d <= radius, d > radius
        self.within(own[inner])
        self.within(own[outer])
        self.across(own[inner & (d > radius - bits)], own[outer & (d <= radius + bits)])


def shard_links(prints: Prints, nodes: np.ndarray, lives: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (node, smallest node of its tree) of the links of a shard that involve one that lives there."""
    forest = Forest(len(nodes))
    meeting = Meeting(prints, forest.link)
    meeting.within(np.flatnonzero(lives))
    meeting.across(np.flatnonzero(lives), np.flatnonzero(~lives))
    return forest.edges(nodes)


def _prints(got: pa.Table | pa.RecordBatch, words: int, bits: int, least: float | None) -> Prints:
    fps = np.stack([got.column(f"f{w}").to_numpy(zero_copy_only=False) if isinstance(got, pa.RecordBatch) else got[f"f{w}"].to_numpy() for w in range(words)], axis=1)
    return Prints(fps.view(np.uint64), None if least is None else np.asarray(got["size"].to_numpy(zero_copy_only=False)), bits, least)


def forest(distinct: DataFrame, words: int, bits: int, least: float | None = None) -> DataFrame:
    """(a, b): a forest that joins all nodes whose fingerprints link.

    distinct: staged rows (node, f0, f1, ... as signed longs, size if least is given), each fingerprint once.
    """
    spark, columns = distinct.sparkSession, [f"f{w}" for w in range(words)] + ["size"] * (least is not None)
    leaves = min(LEAVES, -(-distinct.count() // LEAF))
    sample = distinct.select(*columns).orderBy(F.xxhash64("f0"), *columns).limit(max(1, leaves) * SAMPLE).toArrow()
    shipped = spark.sparkContext.broadcast(grow(_prints(sample, words, bits, least), leaves))
    names = ["leaf", "lives", "node", *columns]
    schema = ", ".join(f"{n} {'boolean' if n == 'lives' else 'long'}" for n in names)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for leaf, at, lives in deal(shipped.value, _prints(batch, words, bits, least)):
                for i in range(0, len(at), 20_000):
                    part = batch.take(pa.array(at[i : i + 20_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, leaf)), pa.array(np.full(part.num_rows, lives)), *(part.column(n) for n in names[2:])], names)

    def links(key: tuple, got: pa.Table) -> pa.Table:
        a, b = shard_links(_prints(got, words, bits, least), got["node"].to_numpy(), got["lives"].to_numpy(zero_copy_only=False))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    sent = distinct.select("node", *columns).mapInArrow(send, schema)
    return sent.groupBy("leaf").applyInArrow(links, "a long, b long")


def near_groups(prints: DataFrame, id_col: str = "doc_id", fp_col: str = "fp", bits: int = 3) -> DataFrame:
    """(fp, component): each distinct fingerprint's smallest document id over all that links reach.

    Two fingerprints link at `bits` or fewer differing bits; the result is exact. Fingerprints whose documents all
    lack an id are left out.
    """
    distinct = staged(prints.groupBy(F.col(fp_col).alias("f0")).agg(F.min(id_col).alias("node")).where("node is not null"), "fingerprints")
    joined = distinct.join(components(staged(forest(distinct, 1, bits), "forest")), "node", "left")
    return joined.select(F.col("f0").alias("fp"), F.coalesce("component", "node").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 3) -> DataFrame:
    """Per row: id, fingerprint (16 lowercase hex digits), component_id (the smallest id reachable, itself included).

    Null, empty and wordless texts have fingerprint zero and link like any other. Rows without an id keep their
    fingerprint and get the component of that fingerprint, or null if no document with an id has it. Repeated rows are
    each returned. An empty table gives an empty one. Only the two named columns are read.
    """
    prints = staged(fingerprints(docs, id_col, text_col), "prints")
    groups = staged(near_groups(prints, id_col, "fp", bits), "groups")
    return prints.join(groups, "fp", "left").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


# ---- groups by the Jaccard coefficient of sets of shingles


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's shingles of lower-cased (A-Z) words, one text after another, and how many.

    A text of fewer words is one shingle; one without words has none.
    """
    data, lengths = string_bytes(pc.fill_null(texts, ""))
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    at, to, starts = word_places(data, lengths)
    words, n = word_hashes(data, at, to - at), np.diff(starts)
    many = np.where(n < size, np.minimum(n, 1), n - size + 1)
    place = np.repeat(starts[:-1] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
    doc = np.repeat(np.arange(len(n)), many)
    span = np.minimum(n, size)[doc]
    h = span.astype(np.uint64)
    for i in range(size):
        on = span > i
        h[on] = mix(h[on] * np.uint64(0x9E3779B97F4A7C15)) ^ words[place[on] + i]
    h = mix(h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[first], np.bincount(doc[first], minlength=len(n))


def set_prints(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key of each set and its fingerprint of SET_WORDS words; the empty set's are zero."""
    key, words, some = np.zeros(len(sizes), np.uint64), np.zeros((len(sizes), SET_WORDS), np.uint64), sizes > 0
    if some.any():
        starts = (np.cumsum(sizes) - sizes)[some]
        key[some] = mix(np.add.reduceat(mix(h + np.uint64(17)), starts) + sizes[some].astype(np.uint64))
        for w in range(SET_WORDS):
            words[some, w] = majorities(mix(h + np.uint64((w + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), sizes[some])
    return key, words


_PRINT = "id long, hash long, key long, size long, " + ", ".join(f"f{w} long" for w in range(SET_WORDS))


def _row_prints(rows: DataFrame, size: int) -> DataFrame:
    """rows (id, hash, text) -> a print for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 2_000_000):
                h, sizes = shingle_sets(part.column(2), size)
                key, words = set_prints(h, sizes)
                columns = [part.column(0), part.column(1), pa.array(key.view(np.int64)), pa.array(sizes), *(pa.array(np.ascontiguousarray(words[:, w]).view(np.int64)) for w in range(SET_WORDS))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _PRINT.split(", ")])

    return rows.select("id", "hash", "text").mapInArrow(run, _PRINT)


class Check:
    """Decides pairs by their sets; pairs that are joined already need no look."""

    def __init__(self, sets: list[np.ndarray], least: Fraction):
        self.sets, self.up, self.down, self.forest, self.looks = sets, least.numerator, least.denominator, Forest(len(sets)), 0

    def reach(self, i: int, j: int) -> bool:
        a, b = self.sets[i], self.sets[j]
        if not len(a) or not len(b):
            return not len(a) and not len(b)
        self.looks += 1
        both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
        return both * self.down >= self.up * (len(a) + len(b) - both)

    def pairs(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            apart = self.forest.label[x] != self.forest.label[y]
            x, y = x[apart], y[apart]
            if not len(x):
                return
            _, first = np.unique(x, return_index=True)  # one partner of each at a time
            hit = np.fromiter((self.reach(i, j) for i, j in zip(x[first].tolist(), y[first].tolist(), strict=True)), bool, len(first))
            self.forest.link(x[first[hit]], y[first[hit]])
            rest = np.ones(len(x), bool)
            rest[first] = False
            x, y = x[rest], y[rest]


def _checked(members: DataFrame, size: int, least: Fraction) -> DataFrame:
    """(a, b): a forest of the keys that pairs of at least this coefficient join, both in one group.

    members: (group, key, text), each key once. Small groups share tasks; a larger one is dealt into blocks that meet in
    pairs, so no task holds more than two blocks.
    """
    spark, bits = members.sparkSession, SET_BITS
    members = members.withColumn("bytes", F.octet_length("text"))
    total = members.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK_BYTES))
    size_of = F.sum("bytes")
    blocks = members.groupBy("group").agg(F.greatest(F.ceil(size_of / BLOCK_BYTES), F.least(F.lit(GROUP_BLOCKS), F.ceil(size_of / GROUP_BYTES))).cast("long").alias("blocks"))
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("key"), F.col("blocks"))).otherwise(0)
    partner = F.explode(F.when(F.col("blocks") > 1, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(F.lit(0).cast("long"))))
    placed = members.join(blocks, "group").withColumn("block", block.cast("long")).withColumn("partner", partner)
    task = F.when(F.col("blocks") > 1, F.concat_ws("/", "group", F.least("block", "partner"), F.greatest("block", "partner"))).otherwise(F.pmod(F.xxhash64("group"), F.lit(tasks)).cast("string"))

    def check(got: pa.Table) -> pa.Table:
        texts = got["text"].combine_chunks()
        h, sizes = shingle_sets(texts, size)
        _, words = set_prints(h, sizes)
        check = Check(np.split(h, np.cumsum(sizes)[:-1]), least)
        meeting = Meeting(Prints(words, sizes, bits, float(least)), check.pairs)
        group, block = got["group"].to_numpy(), got["block"].to_numpy()
        order = np.lexsort((block, group))
        for mine in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            sides = np.split(mine, np.flatnonzero(np.diff(block[mine])) + 1)
            if len(sides) == 2:
                meeting.across(*sides)
            else:
                meeting.within(mine)
        a, b = check.forest.edges(got["key"].to_numpy())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return placed.select(task.alias("task"), "group", "key", "block", "text").groupBy("task").applyInArrow(lambda t: check(t), "a long, b long")


def _marked(hashes: DataFrame) -> DataFrame:
    """A bitmap of hashes in pieces (place, bits): MAP_BITS bits at most in all."""
    at = F.pmod("hash", F.lit(MAP_BITS)) + 1
    return hashes.groupBy(F.bitmap_bucket_number(at).alias("place")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def _split(rows: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose hash may be marked, rows whose hash is not): no row moves."""
    at = F.pmod("hash", F.lit(MAP_BITS)) + 1
    joined = rows.withColumn("place", F.bitmap_bucket_number(at)).join(F.broadcast(marks), "place", "left")  # MAP_BITS bits at most
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    on = F.coalesce(F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1, F.lit(False))
    return joined.where(on).select(*rows.columns), joined.where(~on).select(*rows.columns)


def one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: str = "0.8") -> DataFrame:
    """One row of each group that links of at least this Jaccard coefficient of sets of shingles join, with docs' columns.

    Fingerprints of the sets link at SET_BITS or fewer differing bits where sizes allow the coefficient (never below
    0.8, for which the radius is made); within the groups that these links form, full sets decide each link. A pair of
    the coefficient is missed only if its fingerprints differ in more bits. The row of the smallest id stays, one
    without an id only where the group has none; among rows of one id, that of the smallest hash of all columns, and of
    equal rows one. Null, empty and wordless texts have the empty set and link to each other only. Shingles and sets are
    taken for equal where hashes of 64 bits are. An empty table gives an empty one.
    """
    if Fraction(least) < Fraction(4, 5):
        raise ValueError("the radius is made for coefficients of 0.8 or more")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.select(F.struct(*columns).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(*columns).alias("hash"), F.col(f"`{text_col}`").cast("string").alias("text"))
    prints = staged(_row_prints(named, size), "prints")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("best")
    words = [f"f{w}" for w in range(SET_WORDS)]
    distinct = staged(prints.groupBy("key", "size", *words).agg(best, F.count("*").alias("rows")).withColumnRenamed("key", "node"), "distinct")
    groups = components(staged(forest(distinct, SET_WORDS, SET_BITS, float(Fraction(least))), "near"))
    asked = staged(distinct.join(groups, "node").select("node", F.col("component").alias("group"), "best.id", "best.hash"), "asked")
    texts, _ = _split(named.select("id", "hash", "text"), _marked(asked))
    again = texts.alias("r").join(asked.alias("a"), (F.col("r.hash") == F.col("a.hash")) & F.col("r.id").eqNullSafe(F.col("a.id")))
    members = again.groupBy(F.col("a.node").alias("key"), "group").agg(F.first("text").alias("text"))
    same = components(staged(_checked(staged(members, "members"), size, Fraction(least)), "links"))
    # rows that are alone with their set, which links to no other, stay where they are; the others ask who won
    told = staged(distinct.join(same, "node", "left").select("node", "size", *words, "rows", "best", "component"), "told")
    doubtful = told.where("rows > 1 or component is not null")
    winners = doubtful.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("best").alias("best")).select("best.hash")
    keys = ["key", "size", *words]
    suspects = prints.join(doubtful.withColumnRenamed("node", "key").select(*keys), keys, "left_semi").select("hash")
    asking, alone = _split(named.drop("text"), staged(_marked(suspects), "suspects"))
    sure = told.where("rows = 1 and component is null").select("best.hash")
    stays = asking.join(winners.unionByName(sure), "hash", "left_semi").dropDuplicates(["hash", "id"])
    return alone.unionByName(stays).select("row.*")
