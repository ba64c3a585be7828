"""Embedders: batches of texts to vectors, called from an Arrow function."""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_word = re.compile(r"\w+")


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str], kind: str = "document") -> list[list[float]]: ...


class HashedWords:
    """Bags of words hashed into so many signed places, of unit length; needs no model. Blank texts are zero vectors."""

    def __init__(self, dimension: int = 256):
        self.dimension = dimension

    def embed(self, texts: list[str], kind: str = "document") -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts, strict=True):
            for word in _word.findall(text.lower()):
                h = zlib.crc32(word.encode())
                row[(h >> 1) % self.dimension] += 1 if h & 1 else -1
        size = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, size, out=np.zeros_like(out), where=size > 0).tolist()


class Remote:
    """An embedder behind a call: batches of a limited size, tried again with growing waits when the call says so."""

    def __init__(self, call: Callable[[list[str], str], list[list[float]]], dimension: int, batch: int = 96, attempts: int = 3, may_retry: Callable[[Exception], float | None] = lambda e: None, wait=time.sleep):
        self.call, self.dimension, self.batch, self.attempts, self.may_retry, self.wait = call, dimension, batch, attempts, may_retry, wait

    def embed(self, texts: list[str], kind: str = "document") -> list[list[float]]:
        out = [[0.0] * self.dimension for _ in texts]
        full = [i for i, t in enumerate(texts) if t.strip()]
        for i in range(0, len(full), self.batch):
            part = full[i : i + self.batch]
            for place, vector in zip(part, self._tried([texts[j] for j in part], kind), strict=True):
                out[place] = vector
        return out

    def _tried(self, texts: list[str], kind: str) -> list[list[float]]:
        for attempt in range(1, self.attempts + 1):
            try:
                return self.call(texts, kind)
            except Exception as e:
                pause = self.may_retry(e)
                if pause is None or attempt == self.attempts:
                    raise
                self.wait(pause * attempt)
        raise AssertionError


def embed(chunks: DataFrame, embedder: Embedder | None = None, batch: int = 32, text: str = "text", out: str = "embedding") -> DataFrame:
    """chunks with a vector for each text that is not blank; null for blank texts."""
    embedder = embedder or HashedWords()

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            full, found = [i for i, t in enumerate(texts) if t and t.strip()], [None] * len(texts)
            for i in range(0, len(full), batch):
                part = full[i : i + batch]
                for place, vector in zip(part, embedder.embed([texts.iloc[j] for j in part]), strict=True):
                    found[place] = vector
            yield pd.Series(found)

    return chunks.withColumn(out, vectors(F.col(text)))


def embedding_stats(vectors: DataFrame, batch: int = 32) -> DataFrame:
    n = F.count("embedding")
    return vectors.agg(F.count("*").alias("total"), n.alias("embedded"), (F.count("*") - n).alias("skipped"), F.ceil(n / batch).alias("batches"))
