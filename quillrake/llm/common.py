"""What the corpus operators share: table access, staged tables, Arrow helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quillrake import shipping

#: A word: bytes.split() cuts at exactly space, \t, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shipping.ensure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (one machine only) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'quillrake-shared')}"


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended; the folder is then left to the cluster's cleaner
        pass


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches, one tuple of Python values at a time."""
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def string_bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of strings without nulls, one after another, and their sizes."""
    strings = strings.cast(pa.large_binary())
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], np.diff(offsets)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_places(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of texts that stand one after another begins and ends, and the number of each text's first word."""
    edges = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
    word, some = ~_SPACE[data], lengths > 0
    begins, closes = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    begins[edges[:-1][some]] = word[edges[:-1][some]]
    closes[edges[1:][some] - 1] = word[edges[1:][some] - 1]
    at = np.flatnonzero(begins)
    return at, np.flatnonzero(closes) + 1, np.searchsorted(at, edges)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte intervals, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    masks = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
    out, at, left, which = size.astype(np.uint64), start, size, np.arange(len(start))
    while len(which):
        chunk = eight[at].view(np.uint64)[:, 0] & masks[np.minimum(left, 8)]
        out[which] = mix((out[which] * np.uint64(0x9E3779B97F4A7C15)) ^ chunk)
        on = left > 8
        at, left, which = at[on] + 8, left[on] - 8, which[on]
    return out


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a batch whose strings have about so many bytes; at least one row each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(first, last - first)
        first = last


class Bounded(dict):
    """A memo of at most `most` entries in two generations: what was not asked for during a whole one is forgotten.

    Keys are strings or bytes; those of over 128 are made anew each time, so the memo's memory is bounded.
    """

    def __init__(self, make, most: int = 300_000):
        super().__init__()
        self.make, self.most, self.old = make, most // 2, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(key) > 128:
            return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
