"""Placement by a permutation-filled lookup table.

Each shard walks the slots of a prime-sized table in an order of its own; shards take turns claiming
the next free slot of their order until the table is full. A key hashes to a slot and the slot names
its shard, so placement costs one lookup, loads differ by at most a slot per unit of weight, and
when a shard leaves few slots besides its own change hands. The table has a fixed number of slots,
so it may be broadcast whatever the size of the data.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import documents, fresh

TABLE_SIZE = 65_537
SHARDS = [f"shard-{k:03d}" for k in range(64)]
#: Parts a shard gets of hot keys; the more, the more even the loads, and the more keys are split.
PARTS_PER_SHARD = 128


def fill_table(shards: list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> list[int]:
    """For each slot the index of the shard that claimed it; a shard of weight w claims w slots a turn."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if size < 3 or any(size % k == 0 for k in range(2, math.isqrt(size) + 1)):
        raise ValueError("the table size must be a prime over 2")
    walks = []
    for name in shards:
        digest = hashlib.md5(name.encode()).digest()
        walks.append([int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:], "big") % (size - 1) + 1])
    turns = [(weights or {}).get(name, 1) for name in shards]
    if min(turns) < 0 or not any(turns):
        raise ValueError("weights must not be negative, and one must be positive")
    table, free = [-1] * size, size
    while free:
        for k, walk in enumerate(walks):
            for _ in range(turns[k]):
                if not free:
                    break
                while table[walk[0]] >= 0:
                    walk[0] = (walk[0] + walk[1]) % size
                table[walk[0]], free = k, free - 1
    return table


def table_frame(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> DataFrame:
    """The lookup table as (slot, shard)."""
    filled = F.split(F.lit(",".join(map(str, fill_table(shards, size, weights)))), ",")
    names = F.array(*[F.lit(s) for s in shards])
    rows = spark.range(1).select(F.posexplode(filled).alias("slot", "_k"))
    return rows.select("slot", F.get(names, F.col("_k").cast("int")).alias("shard"))


def place(
    docs: DataFrame, key: str, row_id: str, shards: list[str], size: int = TABLE_SIZE,
    weights: dict[str, int] | None = None, parts_per_shard: int = PARTS_PER_SHARD,
) -> DataFrame:
    """docs with part, slot and shard; rows of one key stay together unless the key is hot.

    A key with over 1/(parts_per_shard * shards) of all rows is hot. It is split by row_id into as
    many parts as keep each under that share. No part is larger, and parts fall on slots by a hash, so
    a shard's load strays from its share by about one part in the root of parts_per_shard: with 64
    shards, 128 parts each and many rows a part (from about a million rows on) the largest load stays
    below 1.4 times the mean, whatever the keys. On fewer rows chance adds to it (1.60 on 1,000 rows,
    1.27 on 10,000), and below a row a part every key counts as hot and is dealt by row.
    There are fewer hot keys than parts_per_shard * shards, so their table is small by construction.
    A null key is a key like others; a null row_id goes to one part; equal rows go to one shard; an
    empty table stays empty. Columns of docs named part, slot or shard are replaced, others stay.
    """
    n, most = docs.count(), parts_per_shard * len(shards)
    kept = docs.drop("part", "slot", "shard")
    hot_key, parts = fresh(kept, "hot", "parts")
    hot = (
        docs.groupBy(F.col(key).alias(hot_key)).count().where(F.col("count") * most > n)
        .select(hot_key, F.ceil(F.col("count") * most / F.lit(max(n, 1))).alias(parts))
    )
    joined = kept.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col(hot_key)), "left")
    part = F.when(F.col(parts).isNotNull(), hashed(F.col(row_id)) % F.col(parts)).otherwise(F.lit(0))
    slotted = joined.withColumn("part", part).withColumn("slot", (hashed(F.col(key), F.col("part")) % F.lit(size)).cast("int"))
    table = F.broadcast(table_frame(docs.sparkSession, shards, size, weights))
    return slotted.join(table, "slot").select(*[F.col(f"`{c}`") for c in kept.columns], "part", "slot", "shard")


def hashed(*of: Column) -> Column:
    """A number below 2^48 from the columns' text; null counts as empty."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in of])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document by its source; see place() for nulls, repeated rows and empty tables."""
    return place(documents(spark, sf_dir).select("doc_id", "source"), "source", "doc_id", SHARDS)


def oracle() -> str:
    """The table is given as it is filled; a test fills it by brute force."""
    most = PARTS_PER_SHARD * len(SHARDS)
    number = lambda x: f"('0x' || substr(md5({x}), 1, 12))::BIGINT"
    return f"""
WITH hot AS (SELECT source AS h, ceil(count(*) * {most} / (SELECT count(*) FROM documents)::DOUBLE)::BIGINT AS parts
  FROM documents GROUP BY source HAVING count(*) * {most} > (SELECT count(*) FROM documents)),
d AS (SELECT doc_id, source, CASE WHEN parts IS NULL THEN 0 ELSE {number("coalesce(doc_id::VARCHAR, '')")} % parts END::BIGINT AS part
  FROM documents LEFT JOIN hot ON source IS NOT DISTINCT FROM h),
s AS (SELECT *, ({number("coalesce(source, '') || '|' || part")} % {TABLE_SIZE})::INT AS slot FROM d),
filled AS (SELECT unnest(range(0, {TABLE_SIZE}))::INT AS slot, unnest({fill_table(SHARDS)}) AS k)
SELECT doc_id, source, part, slot, 'shard-' || lpad(k::VARCHAR, 3, '0') AS shard FROM s JOIN filled USING (slot)
"""
