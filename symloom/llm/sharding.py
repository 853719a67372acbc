"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table (an
offset and a stride taken from its name's hash, so each order is a permutation).
The shards take turns, by weight, and each claims the first free slot of its
order until the table is full.  Placement of a row is one hash, one remainder
and one look-up in the broadcast table, whose size depends on the number of
shards only; adding or losing a shard moves few slots.

Null keys are hashed as the text ``\\N``; repeated keys share a shard; an empty
table gives an empty result; extra columns pass through, except that columns
named ``slot`` or ``shard`` are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots for each shard, at least; the spread between shards is about one part in this number.
SLOTS_PER_SHARD = 100
#: The table is a literal in the plan and a broadcast: a documented bound.
MAX_SLOTS = 1 << 20


def next_prime(n: int) -> int:
    while n < 2 or any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _number(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str], weights: Sequence[int] | None = None, slots: int | None = None) -> list[int]:
    """The shard index in each slot; ``slots`` is raised to a prime."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, one at least")
    weights = list(weights or [1] * len(shards))
    if len(weights) != len(shards) or min(weights) < 0 or not any(weights):
        raise ValueError("weights: one of 0 or more for each shard, not all 0")
    size = next_prime(max(slots or SLOTS_PER_SHARD * sum(weights), len(shards) + 1))
    if size > MAX_SLOTS:
        raise ValueError(f"the table has {size} slots; {MAX_SLOTS} are allowed")
    at = [_number(s, "offset") % size for s in shards]
    stride = [_number(s, "skip") % (size - 1) + 1 for s in shards]
    table, free = [-1] * size, size
    while free:
        for k, weight in enumerate(weights):
            for _ in range(min(weight, free)):
                while table[at[k]] >= 0:
                    at[k] = (at[k] + stride[k]) % size
                table[at[k]] = k
                free -= 1
    return table


def table_frame(spark: SparkSession, table: Sequence[int]) -> DataFrame:
    """(slot, shard) as a DataFrame made by the JVM alone."""
    claimed = F.split(F.lit(",".join(map(str, table))), ",")
    return spark.range(1).select(F.posexplode(claimed).alias("slot", "shard")).select(F.col("slot").cast("long"), F.col("shard").cast("long"))


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key: the first 60 bits of its text's MD5, modulo the prime size."""
    text = F.coalesce(key.cast("string"), F.lit("\\N"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % F.lit(slots)


def assign_shards(df: DataFrame, key: str, table: Sequence[int]) -> DataFrame:
    """``df`` with ``slot`` and ``shard``; no shuffle, one broadcast of ``len(table)`` rows."""
    placed = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), len(table)))
    return placed.join(F.broadcast(table_frame(df.sparkSession, table)), "slot", "left")


def write_shards(df: DataFrame, key: str, table: Sequence[int], path: str, pieces: int = 1) -> None:
    """Write one folder for each shard; ``pieces`` tasks share a shard, dealt by a second hash."""
    placed = assign_shards(df, key, table).drop("slot")
    salt = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(max(1, pieces)))
    placed.repartition("shard", salt).write.mode("overwrite").partitionBy("shard").parquet(path)
