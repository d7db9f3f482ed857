"""Sharding by a permutation-filled lookup table.

Every shard walks the slots of a prime-sized table by its own permutation (offset and step hashed from its name); in turn
each claims its next free slot until the table is full, so shards own equal shares (to one slot) or shares in proportion
to their weights, and a shard that goes takes few other slots with it. The table is a fixed-size array (65,537 entries at
most as set), so it is broadcast and placement is one hash and one look-up, without a shuffle.

Cases: a null key is placed as the empty string; equal keys always go to the same shard; an empty table gives an empty
result; further columns are kept, and the result's names are the caller's choice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def hashed(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def fill(shards: Sequence[str], slots: int = SLOTS, weights: Sequence[float] | None = None) -> np.ndarray:
    """Index of the owning shard of each slot."""
    if not is_prime(slots):
        raise ValueError("the table's size must be prime, so that every step visits all slots")
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards must be named once each, and no more than the slots")
    weights = list(weights or [1.0] * len(shards))
    top = max(weights)
    if min(weights) <= 0:
        raise ValueError("weights must be positive")
    at = [hashed(s, "offset") % slots for s in shards]
    step = [hashed(s, "step") % (slots - 1) + 1 for s in shards]
    owner, credit, filled = [-1] * slots, [0.0] * len(shards), 0
    while True:
        for k in range(len(shards)):
            credit[k] += weights[k] / top
            if credit[k] < 1:
                continue
            credit[k] -= 1
            slot = at[k]
            while owner[slot] >= 0:
                slot = (slot + step[k]) % slots
            owner[slot] = k
            at[k] = (slot + step[k]) % slots
            filled += 1
            if filled == slots:
                return np.array(owner, np.int32)


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """60 bits of the key's MD5, modulo the table's size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(rows: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS, weights: Sequence[float] | None = None, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """``rows`` with the columns ``slot`` and ``shard`` (name of the owning shard)."""
    spark = rows.sparkSession
    owner = fill(shards, slots, weights)
    table = spark.createDataFrame([(i, shards[k]) for i, k in enumerate(owner.tolist())], "__slot int, __shard string")
    placed = rows.withColumn("__at", slot_of(F.col(key), slots)).join(F.broadcast(table), F.col("__at") == F.col("__slot"))  # ``slots`` rows
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in (slot, shard)]
    return placed.select(*kept, F.col("__at").alias(slot), F.col("__shard").alias(shard))
