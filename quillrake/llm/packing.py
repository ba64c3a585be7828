"""Order-preserving packing of token streams by dynamic programming.

Documents keep their order; each input partition packs its own stream in segments of bounded size. Cuts may fall at
document ends (free), sentence ends (cheap) and, so that no long sentence forces padding, at every so many tokens
without such ends (dearer). With P the places of possible cuts, the least cost up to cut j is

    f(j) = penalty(j) + min over i with P(j) - P(i) <= width of f(i) + padding(P(j) - P(i))

Padding is width less length, but nothing for a length that is a power of two. The first form makes the inner minimum
that of f(i) + P(i) over a window that only moves on: a monotone queue gives it in constant time. The powers of two are
single places, looked up beforehand.
"""

from __future__ import annotations

import json
import os
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrake.llm.bpe import PLAIN, STEP_BYTES, PairTable, core_and_marks, laid_out, merge_flat, per_group, spelled
from quillrake.llm.common import slices, string_bytes

#: Costs of a cut in tokens of padding; tokens between cuts that no boundary offers; tokens of a segment; bytes of
#: text whose words are looked up together.
SENTENCE_COST, TOKEN_COST, STRIDE, SEGMENT, SLICE = 4, 24, 32, 1_000_000, 4_000_000


class TextIds:
    """Ids of whole texts by a tokenizers file; the library encodes each text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        stops = re.compile(r"[.!?]+[\"')\]]*(</w>)?")
        self.stops = np.array(sorted(i for t, i in vocab.items() if stops.fullmatch(t)), np.uint32)

    def _library(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of strings, one after another, and how many each has."""
        out, sizes = [np.zeros(0, np.int32)], []
        for i in range(0, len(strings), 4096):  # what the library makes of a string is large, and goes with each part
            found = [x.ids for x in self.tokenizer.encode_batch_fast(strings[i : i + 4096], add_special_tokens=False)]
            sizes += map(len, found)
            out.append(np.fromiter((x for ids in found for x in ids), np.int32, sum(map(len, found))))
        return np.concatenate(out), np.array(sizes, np.int64)

    def _ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self._library(texts.to_pylist())

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after another, each text's closed by end, and how many each text has."""
        ids, sizes = self._ids(pc.fill_null(texts, ""))
        return np.insert(ids, np.cumsum(sizes), end).astype(np.uint32), sizes + 1


class WordIds(TextIds):
    """Ids of a tokenizer that drops white space, folds case and splits letters from marks, without the library's detour.

    Words are cut at ASCII white space, which no token of such a tokenizer spans; ASCII case is folded before, where no
    special token's string can arise. Each distinct word of a slice of texts is merged once, together with all others;
    those of letters and marks after them by merge_flat, the rest by the library. `fits` tells whether a file is such.
    """

    #: The pipeline that is understood, as the file states it (fixed values of the format).
    _KNOWN = ("NFC", "Replace", "Lowercase"), "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.pairs = PairTable(*np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64).reshape(-1, 3).T)
        letter = _byte_letters()
        self.inner, self.last = (np.array([vocab[c + suffix] for c in letter], np.int32) for suffix in ("", model["end_of_word_suffix"]))

    @classmethod
    def fits(cls, path: str) -> bool:
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        model, vocab = parts["model"], parts["model"].get("vocab", {})
        try:
            steps = tuple(x["type"] for x in parts["normalizer"]["normalizers"])
            split, level = parts["pre_tokenizer"]["pretokenizers"]
            known = (steps, split["pattern"]["Regex"]) == cls._KNOWN and split["behavior"] == "Removed" and split["invert"] and level["type"] == "ByteLevel" and not level["add_prefix_space"] and not level["use_regex"]
            plain = model["type"] == "BPE" and not any(model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")) and model["end_of_word_suffix"]
            ids = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
            whole = all(c + suffix in vocab for c in _byte_letters() for suffix in ("", model["end_of_word_suffix"]))
        except (KeyError, TypeError, ValueError):
            return False
        special = all(x["content"].startswith("<|") for x in parts["added_tokens"])
        return bool(known and plain and whole and special and all(a < b for a, b in zip(ids, ids[1:])))  # merges in the order of their ids

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one after another, and how many each has."""
        plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False)
        low = pc.utf8_lower(words.filter(pa.array(plain)))
        plain[plain] = pc.less_equal(pc.binary_length(low), STEP_BYTES).to_numpy(zero_copy_only=False)  # NFC changes none of these letters
        cores, marks, tails = core_and_marks(pc.utf8_lower(words.filter(pa.array(plain))))
        data, sizes = string_bytes(pa.concat_arrays([cores.dictionary.cast(pa.binary()), tails]))
        base, ends = self.inner[data], np.cumsum(sizes) - 1
        base[ends] = self.last[data[ends]]
        ids, sizes = merge_flat(base, sizes, self.pairs)
        more, many = self._library(words.filter(pa.array(~plain)).to_pylist())
        n = len(cores.dictionary)
        sequence, count = spelled(plain, cores.indices.to_numpy(), np.where(marks < 0, -1, marks + n), [1] * len(many), np.arange(len(many)) + n + len(tails))
        got, each = laid_out(np.concatenate([ids, more]), np.concatenate([sizes, many]), sequence)
        return got, per_group(each, count)

    def _ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        special = pc.match_substring(texts, "<|")
        lists = pc.ascii_split_whitespace(pc.if_else(special, texts, pc.ascii_lower(texts)))
        words = lists.flatten().dictionary_encode()
        many = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, sizes = self._words(words.dictionary)
        ids, each = laid_out(flat, sizes, words.indices.to_numpy())
        return ids, per_group(each, many)


def _byte_letters() -> list[str]:
    """The letter that a byte-level tokenizer writes for each byte, asked of the library; bytes of no UTF-8 get blanks."""
    from tokenizers.pre_tokenizers import ByteLevel

    level, letter = ByteLevel(add_prefix_space=False, use_regex=False), [" "] * 256
    points = [*range(0x800), *range(0x800, 0xD800, 0x800), *range(0xE000, 0x10000, 0x800), *range(0x10000, 0x110000, 0x10000)]
    for c in map(chr, points):
        for byte, found in zip(c.encode(), level.pre_tokenize_str(c)[0][0], strict=True):
            letter[byte] = found
    return [x if x != " " else letter[0x21] for x in letter]


def cut_places(ends: np.ndarray, stops: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Where cuts may fall and what each costs. ends: places after each document; stops: places after sentences."""
    total = int(ends[-1])
    spare = np.arange(stride, total, stride)
    bounds = np.sort(np.concatenate([[0], ends, stops]))
    spare = spare[spare - bounds[np.searchsorted(bounds, spare, side="right") - 1] >= stride]
    spare = np.concatenate([spare, np.arange(max(1, total - 2048), total)])
    places = np.concatenate([[0], ends, stops, spare])
    costs = np.concatenate([[0], np.zeros(len(ends), np.int64), np.full(len(stops), SENTENCE_COST), np.full(len(spare), TOKEN_COST)])
    order = np.lexsort((costs, places))
    places, costs = places[order], costs[order]
    first = np.concatenate([[True], places[1:] != places[:-1]])
    return places[first], costs[first]


def best_cuts(places: np.ndarray, costs: np.ndarray, width: int) -> np.ndarray:
    """The cheapest cuts, from the first place to the last."""
    n = len(places)
    at, cost = places.tolist(), costs.tolist()
    exact_j, exact_i = [], []
    power = 1
    while power <= width:
        i = np.searchsorted(places, places - power)
        hit = np.flatnonzero((places[np.minimum(i, n - 1)] == places - power) & (places >= power))
        exact_j.append(hit)
        exact_i.append(i[hit])
        power *= 2
    exact_j, exact_i = np.concatenate(exact_j), np.concatenate(exact_i)
    order = np.argsort(exact_j, kind="stable")
    ej, ei = exact_j[order].tolist() + [n], exact_i[order].tolist()
    best, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(at[0], 0)])  # (f(i) + P(i), i), values ascending
    e = 0
    for j in range(1, n):
        p = at[j]
        while at[queue[0][1]] < p - width:
            queue.popleft()
        value, i = queue[0]
        value += width - p
        while ej[e] == j:
            k = ei[e]
            if best[k] < value:
                value, i = best[k], k
            e += 1
        value += cost[j]
        best[j], back[j] = value, i
        value += p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts, j = [at[-1]], n - 1
    while j:
        j = back[j]
        cuts.append(at[j])
    return np.array(cuts[::-1], np.int64)


def pieces(sizes: np.ndarray, stops: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """The pieces of a segment in order: document number, its start there, place in the stream, length, sequence, offset."""
    ends = np.cumsum(sizes)
    places, costs = cut_places(ends, stops)
    cuts = best_cuts(places, costs, width)
    edges = np.unique(np.concatenate([cuts, ends]))
    at, length = edges[:-1], np.diff(edges)
    doc = np.searchsorted(ends, at, side="right")
    sequence = np.searchsorted(cuts, at, side="right") - 1
    return {"doc": doc, "start": at - (ends - sizes)[doc], "at": at, "length": length, "sequence": sequence, "offset": at - cuts[sequence]}


_tokenizers: dict[str, TextIds] = {}


def _tokenizer(path: str) -> TextIds:
    if path not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[path] = (WordIds if WordIds.fits(path) else TextIds)(path)
    return _tokenizers[path]


def pack(docs: DataFrame, tokenizer_path: str, width: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE) -> DataFrame:
    """One row per piece: id, start, length, ids (binary, unsigned 32-bit little-endian), doc_tokens, sequence_id, offset.

    Each text's ids are followed by end_id; null and empty texts are the end id alone. Each id lies in exactly one
    piece, pieces of a sequence follow one another from offset 0, and no sequence is longer than width. sequence_id is
    unique over the table: the input partition's number and a running number. Rows without an id, repeated rows and
    texts of any length are packed like others; an empty table gives none; other columns are not read.
    The tokenizer's file must be at tokenizer_path on each executor; any tokenizers file will do. slice_bytes (text
    looked up at once) trades memory for time only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _tokenizer(tokenizer_path)
        ids, streams, counts, held, base, pid = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal base
            stream, sizes = np.concatenate(streams), np.concatenate(counts)
            found = pieces(sizes, np.flatnonzero(np.isin(stream, words.stops)) + 1, width)
            data = memoryview(stream.astype("<u4").tobytes())
            cut = [data[4 * a : 4 * (a + n)] for a, n in zip(found["at"].tolist(), found["length"].tolist(), strict=True)]
            sequence = found["sequence"] + base
            base = int(sequence[-1]) + 1
            owner = pa.chunked_array(ids).take(pa.array(found["doc"])).combine_chunks()
            columns = [owner, pa.array(found["start"]), pa.array(found["length"]), pa.array(cut, pa.binary()), pa.array(sizes[found["doc"]]), pa.array(sequence + (pid << 40)), pa.array(found["offset"])]
            return pa.RecordBatch.from_arrays(columns, ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            if not batch.num_rows:
                continue
            pid = batch.column(2)[0].as_py()
            for part in slices(batch, 1, slice_bytes):
                stream, sizes = words.encode(part.column(1), end_id)
                ids.append(part.column(0))
                streams.append(stream)
                counts.append(sizes)
                held += len(stream)
                pa.default_memory_pool().release_unused()
                if held >= SEGMENT:
                    yield flush()
                    ids, streams, counts, held = [], [], [], 0
        if ids:
            yield flush()

    schema = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().alias("pid")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
