"""Placement of rows on shards by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size. The shards take turns; at its turn
a shard claims the first slot of its order that is still free, until all are taken. Every shard so gets the same number
of slots but for one, and without a shard the others keep nearly all of theirs. A row goes to the slot its key hashes
to: one lookup in a table whose size is a parameter, not a function of the data, so it travels as a literal.

Defined cases: a null key is hashed like the text ``null``; equal keys share a shard, repeated rows too; other columns
are not touched; no shards, or a table size that is not prime or too small, is an error.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioframe.llm.common import spare_name

SLOTS = 2039
MOST_SLOTS = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def number(name: str, purpose: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{purpose}|{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of the shard that owns it. The order of ``shards`` matters only for the index."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be named, each once")
    if not is_prime(slots) or not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"the table size must be a prime from the number of shards to {MOST_SLOTS}")
    turns = sorted(range(len(shards)), key=lambda s: shards[s])
    next_slot = [number(name, "offset") % slots for name in shards]
    skip = [number(name, "skip") % (slots - 1) + 1 if slots > 2 else 1 for name in shards]
    owner = [-1] * slots
    for turn in range(slots):
        s = turns[turn % len(turns)]
        while owner[next_slot[s]] >= 0:
            next_slot[s] = (next_slot[s] + skip[s]) % slots
        owner[next_slot[s]] = s
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    digest = F.sha2(F.coalesce(key.cast("string"), F.lit("null")), 256)
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % slots).cast("int")


def placed(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """``df`` with the slot and the shard of each row."""
    table = F.lit(",".join(map(str, lookup_table(shards, slots))))
    names = F.array(*map(F.lit, shards))
    owners = F.split(table, ",").cast("array<int>")  # a constant, folded when the query is planned
    return df.withColumn(slot, slot_of(F.col(key), slots)).withColumn(shard, F.get(names, F.get(owners, F.col(slot))))


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, files_per_shard: int = 1, slots: int = SLOTS) -> None:
    """Write a folder per shard. Slots, not shards, are dealt to tasks, so a shard is written by several of them."""
    slot, part = spare_name(df, "_slot"), spare_name(df, "_part")
    rows = placed(df, key, shards, slots, slot, "shard").withColumn(part, F.col(slot) % files_per_shard)
    rows = rows.repartition(len(shards) * files_per_shard, "shard", part)
    rows.drop(slot, part).write.mode("overwrite").partitionBy("shard").parquet(path)
