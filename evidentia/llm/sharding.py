"""Sharding by weighted rendezvous hashing.

A record's key and a shard's number give a uniform u; the shard with the largest weight / -ln(u)
takes the record.  A further shard changes nothing but the records that it wins itself, and
weights give shares in proportion.  DataFrame functions only.

Slots are numbered without a window over a whole shard or a key: each input task's records are counted
by shard, and a record's slot is the count of the tasks before plus its place among its task's
records, so many records of one key cost no more than others.

Null keys count as one key.  Repeated rows share a shard and get slots of their own, in any order among rows that
are equal.  A null payload has size 1 (0 bytes plus 1); payloads of any length are measured where they lie and
never moved.  An empty table gives an empty result.  Only key and payload are read, so columns of other
names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise



def score(key: Column, shard: int, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double")
    return F.lit(float(weight)) / -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53)))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The winning shard; equal scores go to the smaller number."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    return F.greatest(*(F.struct(score(key, k, w).alias("s"), F.lit(-k).alias("k")) for k, w in enumerate(weights)))["k"] * F.lit(-1) if len(weights) > 1 else F.lit(0)


def shard_rows(docs: DataFrame, weights: list[float], key_col: str = "doc_id", payload_col: str = "text", grown: list[float] | None = None) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard for every row."""
    grown = grown or [*weights, sum(weights) / len(weights)]
    key, text = F.col(f"`{key_col}`"), F.coalesce(F.col(f"`{payload_col}`"), F.lit(""))
    placed = docs.select(
        key.alias("key"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, grown).alias("grown_shard"),
        F.spark_partition_id().alias("part"),
    )
    # written, so that a row stays in the part that it was counted in, even if its task is run again
    placed = materialise(placed, "placed")
    counts = placed.groupBy("shard", "part").count()
    # one row per shard and part: the window sorts parts, not records
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    place = Window.partitionBy("shard", "part").orderBy(F.col("key").asc_nulls_first(), "size", "crc")
    return (
        placed.withColumn("place", F.row_number().over(place))
        .join(offsets, ["shard", "part"])
        .select(
            F.col("key").alias(key_col),
            "size",
            F.col("crc").alias("text_crc32"),
            F.lit("key").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"),
            F.col("grown_shard").cast("int").alias("grown_shard"),
        )
    )
