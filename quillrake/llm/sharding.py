"""Shard placement by a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in an order of its own: an offset and a stride drawn from its name.
Shards take turns claiming the next free slot they prefer until the table is full, so shares differ by one slot at most,
and adding or removing a shard moves few slots beyond its share. A key's slot is its hash modulo the table's size:
placement is one lookup in a broadcast table whose size is fixed by the prime, whatever the data.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots: a prime, well over a hundred times the shards it serves.
SLOTS = 65_537


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The number of the shard that owns each slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards need distinct names, at least one and at most one a slot")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    draws = [hashlib.sha256(s.encode()).digest() for s in shards]
    place = [int.from_bytes(d[:8], "big") % slots for d in draws]
    stride = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 for d in draws]
    owner, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            while owner[place[i]] >= 0:
                place[i] = (place[i] + stride[i]) % slots
            owner[place[i]] = i
            free -= 1
            if not free:
                break
    return owner


def assign(df: DataFrame, key_col: str = "doc_id", shards: list[str] | int = 64, slots: int = SLOTS) -> DataFrame:
    """(key, slot, shard, shard_name) for each row of df.

    The slot is the 64-bit hash of the key modulo the slots. Rows with equal keys share a shard, null keys one of their
    own choosing; an empty table gives an empty one; other columns are not read.
    """
    names = [f"shard-{i:05d}" for i in range(shards)] if isinstance(shards, int) else list(shards)
    table = df.sparkSession.createDataFrame([(s, i, names[i]) for s, i in enumerate(lookup_table(names, slots))], "slot long, shard int, shard_name string")
    keyed = df.select(F.col(key_col).alias("key"), F.pmod(F.xxhash64(key_col), F.lit(slots)).alias("slot"))
    return keyed.join(F.broadcast(table), "slot").select(F.col("key").alias(key_col), "slot", "shard", "shard_name")


def write_sharded(df: DataFrame, path: str, key_col: str = "doc_id", shards: list[str] | int = 64, slots: int = SLOTS, files: int = 1) -> None:
    """Writes df as Parquet, one folder a shard (column shard) and about `files` files in each."""
    names = [f"shard-{i:05d}" for i in range(shards)] if isinstance(shards, int) else list(shards)
    table = df.sparkSession.createDataFrame(list(enumerate(lookup_table(names, slots))), "`__slot` long, shard int")
    placed = df.drop("shard").withColumn("__slot", F.pmod(F.xxhash64(key_col), F.lit(slots))).join(F.broadcast(table), "__slot")
    spread = F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]), F.lit(files))
    placed.withColumn("__file", spread).repartition("shard", "__file").drop("__slot", "__file").write.partitionBy("shard").parquet(path)
