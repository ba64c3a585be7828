"""Byte-level BPE with a segment tree over byte positions.

A match of the splitting pattern is merged by its own tree: leaf i holds the rank of the pair that starts at live
position i together with i, inner nodes the least of their two children, so the root names the leftmost least pair. A
merge is a point update at the merged position, the one that goes and the live neighbour before, each logarithmic in the
match's length. `merge` does this for one match; `merge_flat` for many at once, all trees of a width in one array and
merged in step. Each distinct match of a slice of texts is merged once and its ids are laid out wherever it stands.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrake.llm.common import slices, string_bytes

_NONE = 1 << 62
_FREE = np.int32(2**31 - 1)
#: Longest match, in bytes, that is merged in step with others; text bytes whose matches are looked up together.
STEP_BYTES, SLICE = 512, 4_000_000
#: Letters that every Unicode version of the last twenty years knows as letters, in a form that NFC leaves alone and
#: with a single letter in lower case: libraries agree on them.
LETTERS = r"a-zA-Z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{236}\x{388}-\x{38A}\x{38E}-\x{3A1}\x{3A3}-\x{3CE}\x{400}-\x{481}\x{5D0}-\x{5EA}\x{621}-\x{63A}\x{641}-\x{64A}\x{3041}-\x{3094}\x{30A1}-\x{30FA}\x{4E00}-\x{9FA5}\x{AC00}-\x{D7A3}"
#: ASCII marks: a run of them after letters, up to the string's end, is one match of a pattern's class of other characters.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
#: A string of letters and marks after them.
PLAIN = rf"^ ?[{LETTERS}]+[!-/:-@\[-`{{-~]*$"
#: Characters that Python or Unicode calls white space.
_WHITE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_LOOSE = rf"^ | $| [{_WHITE}]|[{_WHITE}] "
_CUT = re.compile(r"(?<=\S) (?=\S)")


def merge(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match: the pair of least rank, leftmost first, is merged until no pair has a rank."""
    if data in ranks:
        return [ranks[data]]
    n = len(data)
    size = 1 << max(1, (n - 1).bit_length())
    tree = [_NONE] * (2 * size)
    start, after, before = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))
    rank = ranks.get
    for i in range(n - 1):
        tree[size + i] = rank(data[i : i + 2], _NONE)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b

    def put(i: int, value: int) -> None:
        i += size
        if tree[i] == value:
            return
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a <= b else b
            if tree[i] == least:
                return
            tree[i] = least
            i >>= 1

    while (least := tree[1]) != _NONE:
        i = 1
        while i < size:
            i = 2 * i if tree[2 * i] == least else 2 * i + 1
        i -= size
        gone = after[i]
        end[i], after[i] = end[gone], after[gone]
        if after[i] < n:
            before[after[i]] = i
        put(gone, _NONE)
        put(i, rank(data[start[i] : end[after[i]]], _NONE) if after[i] < n else _NONE)
        if (j := before[i]) >= 0:
            put(j, rank(data[start[j] : end[i]], _NONE))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[data[start[i] : end[i]]])
        i = after[i]
    return ids


def read_ranks(lines: list[bytes]) -> dict[bytes, int]:
    """A rank file's lines, each a base64 token and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class PairTable:
    """Ids of what pairs of tokens merge to, by open addressing in flat arrays, so that many pairs are looked up at once."""

    def __init__(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray):
        keys, values = a.astype(np.int64) << 32 | b.astype(np.int64), ids.astype(np.int32)
        self.bits = max(8, (2 * len(keys)).bit_length())
        self.most = int(values.max(initial=0))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _FREE, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of those that want one slot the last stays
            mine = free & (self.keys[slot] == keys)
            self.values[slot[mine]] = values[mine]
            keys, values, slot = keys[~mine], values[~mine], slot[~mine] + 1 & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 32 | b
        slot = self._slot(keys)
        held = self.keys[slot]
        same = held == keys
        out = np.where(same, self.values[slot], _FREE)
        left = np.flatnonzero(~same & (held >= 0))
        while len(left):
            slot[left] = slot[left] + 1 & (1 << self.bits) - 1
            held = self.keys[slot[left]]
            hit = held == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out


def byte_pairs(ranks: dict[bytes, int]) -> PairTable:
    """The pairs of tokens whose bytes together are a token."""
    found = [(a, b, rank) for token, rank in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None]
    return PairTable(*np.array(found, np.int64).reshape(-1, 3).T)


def merge_flat(tokens: np.ndarray, sizes: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """The ids of strings that stand one after another as base tokens, and how many each has.

    An id is its pair's rank: of all pairs the least id merges first, leftmost first. Strings are of STEP_BYTES at most.
    """
    if not len(tokens):
        return tokens.astype(np.int32), sizes
    if pairs.most >= int(_FREE) // STEP_BYTES:
        raise ValueError(f"ids go up to {int(_FREE) // STEP_BYTES}")
    tokens, live, starts = tokens.astype(np.int32), np.ones(len(tokens), bool), np.cumsum(sizes) - sizes
    first, inner = np.full(len(tokens), _FREE, np.int32), np.ones(len(tokens), bool)
    inner[(starts + sizes - 1)[sizes > 0]] = False
    inner = np.flatnonzero(inner)
    for i in range(0, len(inner), 1 << 16):
        at = inner[i : i + (1 << 16)]
        first[at] = pairs.get(tokens[at], tokens[at + 1])
    depth = np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64)
    for d in np.unique(depth[sizes > 1]).tolist():
        mine = np.flatnonzero((depth == d) & (sizes > 1))
        step = max(64, (1 << 17) >> d)
        for i in range(0, len(mine), step):
            _merge_trees(tokens, live, first, starts[mine[i : i + step]], sizes[mine[i : i + step]], d, pairs)
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(live)])
    return tokens[live], before[starts + sizes] - before[starts]


def _merge_trees(tokens: np.ndarray, live: np.ndarray, first: np.ndarray, start: np.ndarray, size: np.ndarray, depth: int, pairs: PairTable) -> None:
    """Merges strings of one width in place; live tells which places keep a token. A leaf is rank * width + position."""
    n, width = len(start), 1 << depth
    place = np.arange(width, dtype=np.int32)
    grid, held = np.minimum(start[:, None] + place, len(tokens) - 1), place < size[:, None]
    leaf = first[grid]
    tree = np.empty((n, 2 * width), np.int32)
    tree[:, width:] = np.where(held & (leaf != _FREE), leaf * np.int32(width) + place, _FREE)
    for level in range(depth - 1, -1, -1):
        at = 1 << level
        np.minimum(tree[:, 2 * at : 4 * at : 2], tree[:, 2 * at + 1 : 4 * at : 2], out=tree[:, at : 2 * at])
    tree = tree.ravel()
    wide = width + 2
    after, before = np.tile(np.arange(1, wide + 1, dtype=np.int32), n), np.tile(np.arange(-1, wide - 1, dtype=np.int32), n)
    keeps, token = np.ones(n * wide, bool), np.zeros((n, wide), np.int32)
    token[:, :width] = tokens[grid]
    token = token.ravel()
    root, row, ends = np.arange(n) * (2 * width), np.arange(n) * wide, size.astype(np.int32)
    best = tree[root + 1]
    while True:
        on = best != _FREE
        if not on.all():
            root, row, ends, best = root[on], row[on], ends[on], best[on]
        if not len(root):
            break
        here, new = best & np.int32(width - 1), best >> np.int32(depth)
        gone = after[row + here]
        then = after[row + gone]
        prev = before[row + here]
        after[row + here], before[row + then], token[row + here], keeps[row + gone] = then, here, new, False
        more, has, prev = then < ends, prev >= 0, np.maximum(prev, 0)
        right = np.where(more, pairs.get(new, token[row + then]), _FREE)
        left = np.where(has, pairs.get(token[row + prev], new), _FREE)
        tree[root + width + gone] = _FREE
        tree[root + width + here] = np.where(right != _FREE, right * np.int32(width) + here, _FREE)
        tree[(root + width + prev)[has]] = np.where(left != _FREE, left * np.int32(width) + prev, _FREE)[has]
        node, base = np.concatenate([gone, here, prev]).astype(np.int64) + width, np.concatenate([root, root, root])
        for _ in range(depth):
            child = base + (node & ~1)
            node >>= 1
            tree[base + node] = np.minimum(tree[child], tree[child + 1])
        best = tree[root + 1]
    live[grid[held]] = keeps.reshape(n, wide)[:, :width][held]
    tokens[grid[held]] = token.reshape(n, wide)[:, :width][held]


def laid_out(flat: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of flat (of these sizes, one after another) in the order of index, and their sizes."""
    many = sizes[index]
    last = np.cumsum(many)
    return flat[np.repeat((np.cumsum(sizes) - sizes)[index] - last + many, many) + np.arange(last[-1] if len(last) else 0)], many


def core_and_marks(strings: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, pa.Array]:
    """Strings without their trailing marks; which marks each has (-1: none) of the distinct runs of marks."""
    cores = pc.utf8_rtrim(strings, MARKS)
    data, sizes = string_bytes(strings)
    rest = sizes - pc.binary_length(cores).to_numpy(zero_copy_only=False)
    some = np.flatnonzero(rest)
    within = np.arange(int(rest.sum())) - np.repeat(np.cumsum(rest) - rest, rest)
    tails = data[np.repeat(np.cumsum(sizes) - rest, rest) + within]
    offsets = np.concatenate([[0], np.cumsum(rest[some])]).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(tails)]).cast(pa.binary()).dictionary_encode()
    marks = np.full(len(strings), -1, np.int64)
    marks[some] = found.indices.to_numpy()
    return cores.dictionary_encode(), marks, found.dictionary


def spelled(plain: np.ndarray, core: np.ndarray, marks: np.ndarray, others: list[int], runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of runs that strings are made of, one string after another, and how many each has.

    Where plain holds, a string is its core's run and that of its marks, if any; others have so many of runs each.
    """
    count = np.empty(len(plain), np.int64)
    count[plain], count[~plain] = 1 + (marks >= 0), others
    starts = np.cumsum(count) - count
    out, taken = np.empty(int(count.sum()), np.int64), np.zeros(int(count.sum()), bool)
    at = starts[plain]
    out[at], taken[at] = core, True
    at = (at + 1)[marks >= 0]
    out[at], taken[at] = marks[marks >= 0], True
    out[~taken] = runs
    return out, count


def per_group(sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of sizes over consecutive groups of so many."""
    before, ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)]), np.cumsum(counts)
    return before[ends] - before[ends - counts]


class Codec:
    """Encodes and decodes on an executor; built once a worker from the shipped rank file.

    With public_tokenizers.PATTERN no match holds white space after something else, so a text may be cut before each
    space that stands between two other characters, and a space, letters and marks are two matches. Other patterns split
    whole texts.
    """

    def __init__(self, blob: bytes, pattern: str):
        self.ranks = read_ranks(blob.splitlines())
        self.pairs = byte_pairs(self.ranks)
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.single < 0).any():
            raise ValueError("the rank file has no rank for some byte")
        tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.tokens, self.decimal = pa.array(tokens, pa.large_binary()), pa.array(map(str, range(len(tokens))), pa.string())
        self.split, self.cuts = regex.compile(pattern).findall, pattern == public_tokenizers.PATTERN
        # a match that is a token is that token, though merges may not lead there
        short = [t for t in self.ranks if 1 < len(t) <= STEP_BYTES]
        _, sizes = self._merged(pa.array(short, pa.binary()))
        self.whole = pa.array([t for t, n in zip(short, sizes.tolist(), strict=True) if n > 1], pa.binary())

    def _merged(self, matches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, sizes = string_bytes(matches)
        return merge_flat(self.single[data], sizes, self.pairs)

    def matches_ids(self, matches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each match (binary), one after another, and how many each has."""
        one_by_one = pc.greater(pc.binary_length(matches), STEP_BYTES)
        if len(self.whole):
            one_by_one = pc.or_(one_by_one, pc.is_in(matches, self.whole))
        alone = np.flatnonzero(one_by_one.to_numpy(zero_copy_only=False))
        if not len(alone):
            return self._merged(matches)
        rest = np.flatnonzero(~one_by_one.to_numpy(zero_copy_only=False))
        ids, sizes = self._merged(matches.take(pa.array(rest)))
        more = [merge(matches[int(i)].as_py(), self.ranks) for i in alone]
        place = np.empty(len(matches), np.int64)
        place[rest], place[alone] = np.arange(len(rest)), len(rest) + np.arange(len(alone))
        return laid_out(np.concatenate([ids, *(np.array(m, np.int32) for m in more)]), np.concatenate([sizes, np.fromiter(map(len, more), np.int64, len(more))]), place)

    def _strings_ids(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct strings, each split by the pattern."""
        plain = pc.match_substring_regex(strings, PLAIN).to_numpy(zero_copy_only=False) if self.cuts else np.zeros(len(strings), bool)
        cores, marks, tails = core_and_marks(strings.filter(pa.array(plain)))
        split = [self.split(s) for s in strings.filter(pa.array(~plain)).to_pylist()]
        flat = pa.array([m for found in split for m in found], pa.string()).dictionary_encode()
        ids, sizes = self.matches_ids(pa.concat_arrays([cores.dictionary.cast(pa.binary()), tails, flat.dictionary.cast(pa.binary())]))
        n = len(cores.dictionary)
        sequence, count = spelled(plain, cores.indices.to_numpy(), np.where(marks < 0, -1, marks + n), list(map(len, split)), flat.indices.to_numpy() + n + len(tails))
        got, each = laid_out(ids, sizes, sequence)
        return got, per_group(each, count)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, ids, counts): ids of the texts in that order, one text after another, and how many each has."""
        n = len(texts)
        if not self.cuts:
            words = texts.dictionary_encode()
            flat, sizes = self._strings_ids(words.dictionary)
            return np.arange(n), *laid_out(flat, sizes, words.indices.to_numpy())
        loose = pc.match_substring_regex(texts, _LOOSE).to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(~loose), np.flatnonzero(loose)])
        cut = pc.split_pattern(texts.filter(pa.array(~loose)), " ")
        odd = pa.array([_CUT.split(t) for t in texts.filter(pa.array(loose)).to_pylist()], pa.list_(pa.string()))
        pieces = np.concatenate([pc.list_value_length(cut).to_numpy(zero_copy_only=False), pc.list_value_length(odd).to_numpy(zero_copy_only=False)]).astype(np.int64)
        words = pa.concat_arrays([cut.flatten(), odd.flatten()]).dictionary_encode()
        distinct, ends = len(words.dictionary), np.cumsum(pieces)
        code = words.indices.to_numpy().astype(np.int64)
        code[ends - pieces] += distinct  # a text's first piece has no space before it
        used = np.zeros(2 * distinct, bool)
        used[code] = True
        kinds = np.flatnonzero(used)
        later = words.dictionary.take(pa.array(kinds[kinds < distinct]))
        strings = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar(" "), later, ""), words.dictionary.take(pa.array(kinds[kinds >= distinct] - distinct))])
        flat, sizes = self._strings_ids(strings)
        ids, many = laid_out(flat, sizes, (np.cumsum(used) - 1)[code])
        return order, ids, per_group(many, pieces)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[memoryview]:
        """The bytes of runs of ids."""
        data, sizes = string_bytes(self.tokens.take(pa.array(ids)))
        return _cut(data, sizes, counts)

    def decimals(self, ids: np.ndarray, counts: np.ndarray) -> list[memoryview]:
        """Runs of ids in decimal, joined by one space."""
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)]).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), self.decimal.take(pa.array(ids))), " ")
        data, sizes = string_bytes(joined)
        return _cut(data, sizes, np.ones(len(counts), np.int64))


def _cut(data: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> list[memoryview]:
    """The bytes of runs of so many strings."""
    before, view = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)]), memoryview(np.ascontiguousarray(data))
    edges = before[np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])].tolist()
    return [view[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(shipped, pattern: str, key: str) -> Codec:
    if (key, pattern) not in _codecs:
        _codecs.clear()
        _codecs[key, pattern] = Codec(shipped.value, pattern)
    return _codecs[key, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): each text by the rank file, without special tokens; null and empty texts give an empty array.

    Rows keep their id, null or repeated; other columns are not read; an empty table gives an empty one. The rank file
    is read on the driver and broadcast: its size is fixed by the vocabulary. It must rank each single byte.
    """

    def run(codec: Codec, ids: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))]

    return _each(docs, ranks_path, pattern, id_col, text_col, "ids array<int>", run)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the inverse of encode; null arrays give null; bytes that are not UTF-8 come back as U+FFFD."""
    shipped, key = _ship(encoded, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped, "", key)
        for batch in batches:
            lists = batch.column(1)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            found = codec.decode(lists.flatten().to_numpy(zero_copy_only=False), counts)
            texts = [bytes(x).decode(errors="replace") if ok else None for x, ok in zip(found, lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256 of the decimal ids joined by one space, decoded_sha256 of the bytes the ids decode to).

    The same ids as encode, digested where they are made, so that no array of ids is moved.
    """

    def run(codec: Codec, ids: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
        shas = [pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string()) for found in (codec.decimals(ids, counts), codec.decode(ids, counts))]
        return [pa.array(counts), *shas]

    return _each(docs, ranks_path, pattern, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", run)


def _ship(df: DataFrame, ranks_path: str):
    with open(ranks_path, "rb") as f:
        blob = f.read()
    return df.sparkSession.sparkContext.broadcast(blob), hashlib.sha256(blob).hexdigest()


def _each(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, schema: str, columns) -> DataFrame:
    shipped, key = _ship(docs, ranks_path)
    names = ["id", *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped, pattern, key)
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                order, ids, counts = codec.encode(pc.fill_null(part.column(1), ""))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(order)), *columns(codec, ids, counts)], names)
                pa.default_memory_pool().release_unused()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id long, {schema}").withColumnRenamed("id", id_col)
