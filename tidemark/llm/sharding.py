"""Operator 10: placing rows on shards through a permutation-filled lookup table.

Each shard has its own preference order over the slots of a table of prime size; the shards take turns, and each
claims the next slot of its order that is free. A row's slot is a hash of its id. Adding or removing a shard
moves few of the other shards' slots, and placing a row is one look into the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The production table: its two int columns are about 1 MB wherever they are broadcast, whatever the data.
SLOTS = 65_537
MOST_SLOTS = 1_000_003
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8, key=salt.encode()).digest(), "little")


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of its shard in ``shards``. ``slots`` is a prime above the number of shards."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need to be there and to have names of their own")
    if not len(shards) < slots <= MOST_SLOTS or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots needs to be a prime above the number of shards, {MOST_SLOTS} at most")
    at = [_hash(x, "offset") % slots for x in shards]
    step = [_hash(x, "skip") % (slots - 1) + 1 for x in shards]
    owner, free = [-1] * slots, slots
    while True:
        for k in range(len(shards)):
            slot = at[k]
            while owner[slot] >= 0:
                slot = (slot + step[k]) % slots
            owner[slot], at[k] = k, (slot + step[k]) % slots
            free -= 1
            if not free:
                return owner


def place(docs: DataFrame, shards: Sequence[str] = SHARDS, *, slots: int = SLOTS, id_col: str = "doc_id", text_col: str | None = "text") -> DataFrame:
    """Returns doc_id, slot (int), shard (string) for each row.

    The slot is the id's hash modulo the table size, so rows with the same id meet on a shard. A null id is replaced by
    the hash of the text, so that such rows spread; null in both is slot 0. Repeated rows stay. Other columns are ignored.
    """
    spark = docs.sparkSession
    owner = lookup_table(shards, slots)
    small = spark.createDataFrame([(i, shards[k]) for i, k in enumerate(owner)], "slot int, shard string")
    key = F.xxhash64(F.col(id_col))
    other = F.xxhash64(F.col(text_col)) if text_col else F.lit(0)
    slot = F.when(F.col(id_col).isNotNull(), F.pmod(key, F.lit(slots)))
    slot = slot.when(F.col(text_col).isNotNull(), F.pmod(other, F.lit(slots))) if text_col else slot
    return docs.select(F.col(id_col).alias("doc_id"), slot.otherwise(0).cast("int").alias("slot")).join(F.broadcast(small), "slot", "left").select("doc_id", "slot", "shard")


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents"))
