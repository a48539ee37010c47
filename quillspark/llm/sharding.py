"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table. The
shards take turns, each claiming the first slot of its permutation that is
still free, until the table is full; so all shards get equal parts to within
one slot, and adding or losing a shard moves few keys. A row's key is hashed
to a slot, and a broadcast of the table gives its shard in constant time.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The table's size is a parameter, and this is the most it can be; that bounds the broadcast.
MAX_SLOTS = 1 << 20


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = 5003) -> list[int]:
    """The index of the shard that holds each slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards: one or more different names")
    if not _is_prime(slots) or not len(shards) <= slots <= MAX_SLOTS:
        raise ValueError(f"slots: a prime from the number of shards to {MAX_SLOTS}")
    steps = []
    for name in shards:
        d = hashlib.sha256(name.encode()).digest()
        steps.append((int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1 if slots > 2 else 1))
    table, tried, left = [-1] * slots, [0] * len(shards), slots
    while left:
        for i, (offset, skip) in enumerate(steps):
            while table[slot := (offset + tried[i] * skip) % slots] >= 0:
                tried[i] += 1
            table[slot] = i
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key: 60 bits of the MD5 of its text modulo ``slots``; a
    null key counts as the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str, shards: list[str], slots: int = 5003, out: str = "shard", slot_out: str | None = None) -> DataFrame:
    """``df`` with the shard of each row in ``out`` (and its slot in
    ``slot_out``), columns of these names being replaced.

    Equal keys, repeated rows included, share a shard; null keys share the
    shard of the empty text; an empty table stays empty; no row is lost.
    """
    table = lookup_table(shards, slots)
    names = F.array(*[F.lit(s) for s in shards])
    lookup = df.sparkSession.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, table))), ",")).alias("__slot", "__i"))
    lookup = lookup.select("__slot", F.element_at(names, F.col("__i").cast("int") + 1).alias("__shard"))
    placed = df.withColumn("__at", slot_of(F.col(f"`{key}`"), slots)).join(F.broadcast(lookup), F.col("__at") == F.col("__slot"))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (out, slot_out)]
    return placed.select(*kept, *([F.col("__slot").alias(slot_out)] if slot_out else []), F.col("__shard").alias(out))
