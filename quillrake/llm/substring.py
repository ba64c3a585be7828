"""Exact substring deduplication with difference-cover anchors.

A run of `window` words that two documents share is found without hashing each position of each document: word
positions p with p mod `period` in a difference cover are anchors, hashed over window - period + 1 words. For any two
alignments some shift below `period` brings both positions into the cover, so each shared run shares an aligned
anchor. Only windows around shared anchors are then extended to full windows and compared by hashes of 127 bits.

Documents are dealt into batches by a hash of their id. A batch sends each anchor or window hash once, however often
its documents hold it, so a passage that a third of all documents share reaches a bucket once per batch. Buckets
answer batches with what others hold; batches apply the answers to their own texts. The texts are shuffled once (the
three uses share one exchange), and everything else that moves is packed arrays of 8 or 24 bytes an entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from quillrake.llm.common import mix, string_bytes, word_hashes, word_places

#: Perfect difference covers: each residue modulo the period is a difference of two members.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Text bytes that a batch holds on average, and text bytes whose hashes a bucket holds.
BATCH_BYTES, BUCKET_BYTES = 3_000_000, 64_000_000

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_ONE = np.uint64(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


class _Rolling:
    """Hashes of any word interval of a batch's concatenated words, from prefix sums modulo 2**64."""

    def __init__(self, words: np.ndarray):
        self.n, self.words = len(words), words
        self._sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, start: np.ndarray, length: int, which: int = 0) -> np.ndarray:
        if which not in self._sums:
            base = _BASES[which]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.words if which == 0 else mix(self.words)) * _powers(base, self.n)[: self.n])])
            self._sums[which] = sums, _powers(np.uint64(pow(int(base), -1, 1 << 64)), self.n)
        sums, inverse = self._sums[which]
        return mix((sums[start + length] - sums[start]) * inverse[start])


class _Known:
    """A set of hashes that answers which of many it holds; a bitmap rules out most at the cost of one look."""

    def __init__(self, *keys: np.ndarray):
        order = np.lexsort(keys[::-1])
        self.order, self.keys = order, [k[order] for k in keys]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.keys[0] >> np.uint64(44)] = True

    def maybe(self, first: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.bits[first >> np.uint64(44)])

    def find(self, *keys: np.ndarray) -> np.ndarray:
        """The place of each among the set's entries as they were given, -1 where there is none."""
        out, n = np.full(len(keys[0]), -1, np.int64), len(self.order)
        at, which = np.searchsorted(self.keys[0], keys[0]), np.arange(len(keys[0]))
        while len(which):
            on = at < n
            on[on] = self.keys[0][at[on]] == keys[0][which[on]]
            at, which = at[on], which[on]
            same = np.ones(len(at), bool)
            for mine, asked in zip(self.keys[1:], keys[1:], strict=True):
                same &= mine[at] == asked[which]
            out[which[same]] = self.order[at[same]]
            at, which = at[~same] + 1, which[~same]
        return out


class _Batch:
    """Documents of one batch in the order of their ids: their words' places in the bytes, and the words' hashes."""

    def __init__(self, docs: pa.Table, id_col: str, text_col: str):
        ids = docs[id_col].to_numpy(zero_copy_only=False)
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order]
        texts = docs[text_col].combine_chunks() if docs.num_rows else pa.array([], pa.string())
        self.data, length = string_bytes(pc.fill_null(texts.take(pa.array(self.order)), ""))
        self.at, self.to, self.starts = word_places(self.data, length)
        self.sizes = np.diff(self.starts)
        self.doc = np.repeat(np.arange(len(self.ids)), self.sizes)
        self.hashes = word_hashes(self.data, self.at, self.to - self.at)
        self.rolling = _Rolling(self.hashes)

    def windows(self, length: int) -> np.ndarray:
        """Starts, in the concatenation of words, of the windows of so many words that lie in one document."""
        many = np.maximum(0, self.sizes - length + 1)
        return np.repeat(self.starts[:-1] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))

    def anchors(self, window: int, period: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the anchors of documents that hold a window."""
        length = window - period + 1
        at = self.windows(length)
        d = self.doc[at]
        cover = np.zeros(period, bool)
        cover[list(COVERS[period])] = True
        at = at[cover[(at - self.starts[d]) % period] & (self.sizes[d] >= window)]
        return at, self.rolling.of(at, length) & ~_ONE

    def kept(self, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of each document's kept words, joined by one space, one after another, and where they begin and end."""
        stay = np.flatnonzero(~gone)
        turn = np.zeros(len(self.data) + 1, np.int8)
        turn[self.at[stay]] += 1
        turn[self.to[stay]] -= 1
        mask = np.cumsum(turn[:-1], dtype=np.int8).view(bool)
        d = self.doc[stay]
        later = np.concatenate([np.zeros(min(1, len(d)), bool), d[1:] == d[:-1]])
        blank = self.at[stay][later] - 1  # a word that is not the first has white space before it
        mask[blank] = True
        data = self.data.copy()
        data[blank] = 32
        size = np.bincount(d, weights=(self.to - self.at)[stay] + later, minlength=len(self.ids)).astype(np.int64)
        return data[mask], np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])

    def lost(self, gone: np.ndarray) -> np.ndarray:
        """How many words of each document go."""
        return np.bincount(self.doc[gone], minlength=len(self.ids))


def _to_buckets(batch: int, hashes: np.ndarray, columns: list[np.ndarray], buckets: int) -> pa.Table:
    """Rows (bucket, batch, blob); a blob is its columns' bytes, one after another."""
    bucket = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    full, first = np.unique(bucket[order], return_index=True)
    columns, cuts = [c[order] for c in columns], np.append(first, len(order)).tolist()
    blobs = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"bucket": pa.array(full), "batch": pa.array(np.full(len(full), batch)), "blob": pa.array(blobs, pa.binary())})


def _answers(batches: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """Rows (batch, blob) of the values for each batch; a blob is its columns' bytes, one after another."""
    order = np.argsort(batches, kind="stable")
    ids, first = np.unique(batches[order], return_index=True)
    columns, cuts = tuple(c[order] for c in columns), np.append(first, len(order)).tolist()
    blobs = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"batch": pa.array(ids, pa.int64()), "blob": pa.array(blobs, pa.binary())})


def _columns(blobs: pa.ChunkedArray, n: int) -> np.ndarray:
    """The n columns of blobs, one row each."""
    return np.concatenate([np.zeros((n, 0), np.uint64), *(np.frombuffer(b, np.uint64).reshape(n, -1) for b in blobs.to_pylist())], axis=1)


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, in sorted columns."""
    first = np.ones(len(keys[0]), bool)
    first[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return first


class _Steps:
    """The functions that run on executors, with their parameters."""

    def __init__(self, id_col: str, text_col: str, window: int, period: int, buckets: int):
        self.id_col, self.text_col, self.window, self.period, self.buckets = id_col, text_col, window, period, buckets

    def send_anchors(self, key: tuple, docs: pa.Table) -> pa.Table:
        batch = _Batch(docs, self.id_col, self.text_col)
        at, h = batch.anchors(self.window, self.period)
        order = np.argsort(h, kind="stable")  # places, and so ids, ascend already
        h, ids = h[order], batch.ids[batch.doc[at]][order]
        first = np.flatnonzero(_firsts(h))
        last = np.append(first, len(h))[1:] - 1
        many = (ids[first] != ids[last]).astype(np.uint64)
        return _to_buckets(key[0].as_py(), h[first], [h[first] | many], self.buckets)

    def share_anchors(self, key: tuple, got: pa.Table) -> pa.Table:
        """Answers each batch with those of its anchors that another document holds."""
        blobs = [np.frombuffer(b, np.uint64) for b in got["blob"].to_pylist()]
        h = np.concatenate(blobs)
        owner = np.repeat(got["batch"].to_numpy(), [len(b) for b in blobs])
        order = np.argsort(h & ~_ONE, kind="stable")
        h, owner = h[order], owner[order]
        first = _firsts(h & ~_ONE)
        alone = first & np.append(first, True)[1:]
        keep = ~alone | (h & _ONE).astype(bool)
        return _answers(owner[keep], h[keep] & ~_ONE)

    def send_windows(self, key: tuple, docs: pa.Table, shared: pa.Table) -> pa.Table:
        """Sends each distinct window near a shared anchor with its least id; the second hash's last bit: another id has it too."""
        batch = _Batch(docs, self.id_col, self.text_col)
        at, h = batch.anchors(self.window, self.period)
        known = _Known(_columns(shared["blob"], 1)[0])
        some = known.maybe(h)
        at = at[some[known.find(h[some]) >= 0]]
        near = np.zeros(len(batch.hashes) + 1, np.int64)
        np.add.at(near, np.maximum(at - self.period + 1, batch.starts[batch.doc[at]]), 1)
        np.add.at(near, at + 1, -1)
        starts = batch.windows(self.window)
        starts = starts[np.cumsum(near)[starts] > 0]
        w1, w2, ids = batch.rolling.of(starts, self.window), batch.rolling.of(starts, self.window, 1) & ~_ONE, batch.ids[batch.doc[starts]]
        order = np.lexsort((w2, w1))  # stable: ids ascend within equal windows
        w1, w2, ids = w1[order], w2[order], ids[order]
        first = np.flatnonzero(_firsts(w1, w2))
        many = (ids[first] != ids[np.append(first, len(w1))[1:] - 1]).astype(np.uint64)
        return _to_buckets(key[0].as_py(), w1[first], [w1[first], w2[first] | many, ids[first].astype(np.int64)], self.buckets)

    def share_windows(self, key: tuple, got: pa.Table) -> pa.Table:
        """Answers each batch with its windows that start in several documents, and the least id of these."""
        blobs = [np.frombuffer(b, np.uint64).reshape(3, -1) for b in got["blob"].to_pylist()]
        w1, w2, ids = np.concatenate(blobs, axis=1)
        ids, many, w2 = ids.view(np.int64), (w2 & _ONE).astype(bool), w2 & ~_ONE
        owner = np.repeat(got["batch"].to_numpy(), [b.shape[1] for b in blobs])
        order = np.lexsort((ids, w2, w1))
        w1, w2, ids, owner, many = w1[order], w2[order], ids[order], owner[order], many[order]
        first = _firsts(w1, w2)
        least = ids[first][np.cumsum(first) - 1] if len(ids) else ids
        keep = (ids > least) | many
        return _answers(owner[keep], w1[keep], w2[keep], least[keep].view(np.uint64))

    def removed(self, batch: _Batch, found: pa.Table) -> np.ndarray:
        """For each word of the batch: is it removed?"""
        w1, w2, least = _columns(found["blob"], 3)
        known = _Known(w1, w2)
        starts = batch.windows(self.window)
        h = batch.rolling.of(starts, self.window)
        some = known.maybe(h)
        starts, h = starts[some], h[some]
        where = known.find(h, batch.rolling.of(starts, self.window, 1) & ~_ONE)
        starts, where = starts[where >= 0], where[where >= 0]
        starts = starts[batch.ids[batch.doc[starts]] > least.view(np.int64)[where]]
        cover = np.zeros(len(batch.hashes) + 1, np.int64)
        cover[starts] += 1
        cover[starts + self.window] -= 1
        return np.cumsum(cover)[:-1] > 0

    def digest(self, key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        batch = _Batch(docs, self.id_col, self.text_col)
        gone = self.removed(batch, found)
        data, edges = batch.kept(gone)
        view, edges = memoryview(data), edges.tolist()
        shas = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table({self.id_col: pa.array(batch.ids, pa.int64()), "n_words": pa.array(batch.sizes, pa.int64()), "n_removed": pa.array(batch.lost(gone), pa.int64()), "kept_sha256": pa.array(shas, pa.string())})

    def texts(self, key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        """What is left of each changed text, and the [start, end) spans of words removed; once for rows that are equal."""
        batch = _Batch(docs, self.id_col, self.text_col)
        gone = self.removed(batch, found)
        data, edges = batch.kept(gone)
        column, ids, hashes, left, spans = docs[self.text_col].combine_chunks(), [], [], [], []
        seen: set[tuple[int, bytes]] = set()
        for d in np.flatnonzero(batch.lost(gone)).tolist():
            i, text = int(batch.ids[d]), column[int(batch.order[d])].as_py().encode()
            if (i, text) not in seen:
                seen.add((i, text))
                out = gone[batch.starts[d] : batch.starts[d + 1]]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))
                ids.append(i)
                hashes.append(xxhash.xxh64_intdigest(text, 42))
                left.append(data[edges[d] : edges[d + 1]].tobytes().decode())
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        signed = pa.array(np.array(hashes, np.uint64).view(np.int64))
        return pa.table({self.id_col: pa.array(ids, pa.int64()), "text_hash": signed, "kept_text": pa.array(left, pa.string()), "removed_spans": pa.array(spans, kind)})

    def rows(self, key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        """The batch's rows with what is left of their texts and whether they changed; those that lost all words go."""
        batch = _Batch(docs, self.id_col, self.text_col)
        gone = self.removed(batch, found)
        data, edges = batch.kept(gone)
        lost, changed, kept = batch.lost(gone), np.zeros(docs.num_rows, bool), np.ones(docs.num_rows, bool)
        hit = np.flatnonzero(lost)
        changed[batch.order[hit]], kept[batch.order[hit]] = True, lost[hit] < batch.sizes[hit]
        new = [data[edges[d] : edges[d + 1]].tobytes().decode() for d in hit[np.argsort(batch.order[hit])].tolist()]
        at = docs.schema.get_field_index(self.text_col)
        old = docs[self.text_col].combine_chunks() if docs.num_rows else pa.array([], pa.string())
        texts = pc.replace_with_mask(old, pa.array(changed), pa.array(new, old.type))
        return docs.set_column(at, docs.schema.field(at), texts).drop_columns(["batch"]).append_column("changed", pa.array(changed)).filter(pa.array(kept))


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")


def _run(docs: DataFrame, id_col: str, text_col: str, window: int, period: int, last: str, schema) -> DataFrame:
    if period not in COVERS or not period <= window:
        raise ValueError(f"period is one of {sorted(COVERS)}, at most the window")
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    batches = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BATCH_BYTES))
    steps = _Steps(id_col, text_col, window, period, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES)))
    dealt = docs.withColumn("batch", F.pmod(F.xxhash64(id_col), F.lit(batches))).groupBy("batch")
    to_bucket, to_batch = "bucket long, batch long, blob binary", "batch long, blob binary"
    finish = getattr(steps, last)
    by = lambda df, name: df.groupBy(name)
    anchors = by(by(dealt.applyInArrow(lambda k, d: steps.send_anchors(k, d), to_bucket), "bucket").applyInArrow(lambda k, d: steps.share_anchors(k, d), to_batch), "batch")
    windows = by(by(dealt.cogroup(anchors).applyInArrow(lambda k, d, x: steps.send_windows(k, d, x), to_bucket), "bucket").applyInArrow(lambda k, d: steps.share_windows(k, d), to_batch), "batch")
    return dealt.cogroup(windows).applyInArrow(lambda k, d, x: finish(k, d, x), schema)


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, period: int = 31) -> DataFrame:
    """Per document: id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    A word goes if a window of `window` consecutive words covers it whose word sequence also starts in a document
    with a smaller id. Null texts have no words; texts shorter than a window lose none; rows of one id count as one
    document's copies and never remove each other; rows without an id are left out; an empty table gives none.
    Only the two named columns are read, so other columns of any name do no harm.
    """
    return _run(_named(docs, id_col, text_col), "id", "text", window, period, "digest", "id long, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("id", id_col)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, period: int = 31) -> DataFrame:
    """The documents that lose words: id, text_hash, kept_text (kept words joined by one space), removed_spans of word places.

    Same rules as repeated_words; documents that lose nothing are not returned, and rows of equal id and text once.
    text_hash is xxhash64(text), so that id and hash find the row again.
    """
    return _run(_named(docs, id_col, text_col), "id", "text", window, period, "texts", "id long, text_hash long, kept_text string, removed_spans array<struct<start:long,end:long>>").withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, period: int = 31) -> DataFrame:
    """The rows of docs, all columns, with repeated words cut from their texts, and __changed: did the text change?

    Same rules as repeated_words. A changed text is its kept words joined by one space; rows that lose all words go;
    rows without an id stay as they are. Rows travel with their texts, so no join moves the texts again.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    wide = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).withColumns({names[id_col]: F.col(names[id_col]).cast("long"), names[text_col]: F.col(names[text_col]).cast("string")})
    schema = StructType([*wide.schema.fields, StructField("changed", BooleanType())])
    cut = _run(wide.where(F.col(names[id_col]).isNotNull()), names[id_col], names[text_col], window, period, "rows", schema)
    whole = cut.unionByName(wide.where(F.col(names[id_col]).isNull()).withColumn("changed", F.lit(False)))
    return whole.select(*[F.col(n).alias(c) for c, n in names.items()], F.col("changed").alias("__changed"))
