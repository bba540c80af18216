"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each record goes to the shard with the smallest -ln(u) / weight, where u in (0, 1) is a hash of key and
shard. Key, shards and weights alone decide. With one shard more, a record moves only if the
new shard wins it; with one less, only that shard's records move.

Slots number the records of a shard from 0 without gaps. Rows are numbered in buckets of each
shard, behind the running total of the buckets before, so no task holds a whole shard. The
buckets come from row numbers stored in the shared folder: a retried task sees the same ones.

Only DataFrame functions are used. Defined cases: a null key is a key like any other (its hash
depends on the shard alone); repeated rows go to the same shard, each with its own slot; null
text has size 1 and checksum 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, materialise, need

BUCKETS = 1024


def shard_of(key: F.Column, weights: Mapping[int, float]) -> F.Column:
    """The shard of a key; ties go to the lower shard."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("shards need weights above 0")

    def cost(shard: int, weight: float) -> F.Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(int(shard)).cast("long")), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.ln(u) / F.lit(float(weight))).alias("cost"), F.lit(int(shard)).alias("shard"))

    costs = [cost(s, w) for s, w in sorted(weights.items())]
    return (F.least(*costs) if len(costs) > 1 else costs[0])["shard"]


def numbered(df: DataFrame, shard: str, slot: str) -> DataFrame:
    """``df`` with ``slot`` numbering the rows of each shard from 0."""
    uid, bucket, offset = (fresh(n, [*df.columns, slot]) for n in ("_uid", "_bucket", "_offset"))
    rows = materialise(df.withColumn(uid, F.monotonically_increasing_id()))
    rows = rows.withColumn(bucket, F.pmod(F.xxhash64(uid), F.lit(BUCKETS)).cast("int"))
    before = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(shard, bucket).count()
    sums = sums.select(shard, bucket, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(offset))
    inside = Window.partitionBy(shard, bucket).orderBy(uid)
    # A row per shard and bucket: its size depends on the number of shards alone.
    rows = rows.withColumn(slot, F.row_number().over(inside) - 1).join(F.broadcast(sums), [shard, bucket])
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(slot) + F.col(offset)).cast("long").alias(slot))


def shard(docs: DataFrame, weights: Mapping[int, float], *, key: str = "doc_id", names: tuple[str, str] = ("shard", "slot")) -> DataFrame:
    """All columns and the shard and slot (an underscore more on names that clash)."""
    need(docs, key)
    name = fresh(names[0], docs.columns)
    placed = docs.withColumn(name, shard_of(F.col(f"`{key}`"), weights))
    return numbered(placed, name, fresh(names[1], placed.columns))


def digest(docs: DataFrame, shards: int = 8) -> DataFrame:
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), dict.fromkeys(range(shards + 1), 1.0)).alias("grown_shard"),
    )
    done = shard(rows, dict.fromkeys(range(shards), 1.0))
    return done.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
