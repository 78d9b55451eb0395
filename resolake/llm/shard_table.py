"""Consistent sharding through a permutation-filled lookup table.

Every shard has a preference order of the table's slots, a permutation given by
an offset and a step modulo the prime table size. Shards take turns, each
claiming the first free slot of its order, until the table is full: shards get
equal slots, and adding or removing one moves few keys. A key goes to the shard
in the slot of its hash, one lookup in a broadcast table of fixed size.

Contract for odd input
----------------------
A null key counts as the empty string. Rows that repeat a key share a shard.
All columns of the input stay; slot and shard replace columns of that name. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

MAX_SLOTS = 1 << 20


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def key_hash(column: Column) -> Column:
    """60 bits of md5 as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def lookup_table(shards: list[str], slots: int) -> list[int]:
    """The number of the shard in each slot. Its size is a parameter, at most MAX_SLOTS, whatever the data."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct names, at least one")
    if not len(shards) <= slots <= MAX_SLOTS or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)) or slots < 2:
        raise ValueError(f"the table size must be a prime from the number of shards to {MAX_SLOTS}")
    place = [_hash(f"{s}:offset") % slots for s in shards]
    step = [_hash(f"{s}:step") % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    for turn in range(slots):
        s = turn % len(shards)
        while owner[place[s]] >= 0:
            place[s] = (place[s] + step[s]) % slots
        owner[place[s]] = s
    return owner


def assign_shards(rows: DataFrame, key_col: str, shards: list[str], slots: int = 4093) -> DataFrame:
    """The rows with slot and shard. Nothing but the table is moved; its rows are the slots, sent to every task."""
    owners = ",".join(str(s) for s in lookup_table(shards, slots))
    lookup = rows.sparkSession.range(1, numPartitions=1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner"))
    shard = F.element_at(F.array(*map(F.lit, shards)), F.col("owner").cast("int") + 1)
    lookup = lookup.select(F.col("slot").cast("long").alias("slot"), shard.alias("shard"))
    others = [F.col(quoted(c)) for c in rows.columns if c.lower() not in ("slot", "shard")]
    keyed = rows.select(*others, (key_hash(F.col(quoted(key_col))) % slots).alias("slot"))
    return keyed.join(F.broadcast(lookup), "slot").select(*others, "slot", "shard")


def write_shards(rows: DataFrame, key_col: str, shards: list[str], path: str, slots: int = 4093, files_per_shard: int = 1) -> None:
    """One folder a shard; a salt from each row's hash spreads a shard over files_per_shard writers, hot keys too."""
    placed = assign_shards(rows, key_col, shards, slots)
    salt = F.pmod(F.xxhash64(*[F.col(quoted(c)) for c in placed.columns]), F.lit(files_per_shard))
    placed.repartition(len(shards) * files_per_shard, "shard", salt).write.mode("overwrite").partitionBy("shard").parquet(path)


def shard_sql(shards: list[str], slots: int = 4093) -> str:
    names = ", ".join(f"({i}, '{s}')" for i, s in enumerate(shards))
    h = lambda x: f"('0x' || substr(md5({x}), 1, 15))::bigint"
    return f"""
with recursive names(i, shard) as (values {names}),
orders as (select i, shard, {h("shard || ':offset'")} % {slots} as off, {h("shard || ':step'")} % {slots - 1} + 1 as step from names),
fill(turn, claimed, owner) as (
  select 0, -1::bigint, list_transform(range({slots}), lambda x: -1::bigint)
  union all
  select turn + 1, slot, list_transform(range({slots}), lambda x: case when x = slot then i::bigint else owner[x + 1] end)
  from (select turn, owner, i, (off + list_filter(range({slots}), lambda j: owner[(off + j * step) % {slots} + 1] < 0)[1] * step) % {slots} as slot
        from fill join orders on orders.i = turn % {len(shards)} where turn < {slots}) t),
placed as (select claimed as slot, shard from fill join names on names.i = (turn - 1) % {len(shards)} where turn > 0)
select doc_id, k.slot, shard from (select doc_id, {h("coalesce(doc_id::varchar, '')")} % {slots} as slot from documents) k join placed on k.slot = placed.slot"""
