"""Helpers that operators share, and operators on very many rows of one key."""

import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evidentia.llm import bpe, common, sharding
from evidentia.llm.queries import op2_grace_dedup


@pytest.mark.parametrize(("given", "want"), [("64m", 64 << 20), ("4194304b", 4 << 20), ("4194304", 4 << 20), ("1GB", 1 << 30), ("512k", 512 << 10), ("2kb", 2048)])
def test_sizes_as_spark_spells_them(given, want):
    assert common.byte_size(given) == want


@pytest.mark.parametrize(("given", "want"), [("64m", common.BATCH_BYTES), ("1m", 1 << 20)])
def test_batches_are_bounded(spark, given, want):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, given)
        common.bound_batches(spark)
        assert common.byte_size(spark.conf.get(key)) == want
        docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
        assert bpe.encode(docs, *_coder()).count() == 2
    finally:
        spark.conf.set(key, before)


def _coder():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.PATTERN


def test_a_sieve_loses_no_key(spark):
    keys = spark.range(0, 40_000, 7).withColumnRenamed("id", "k")
    rows = spark.range(200_000)
    kept = rows.filter(common.may_hold(common.sieve(keys, "k").scalar(), "id"))
    assert kept.join(keys, F.col("id") == F.col("k")).count() == keys.count()
    assert kept.count() < 1.2 * keys.count()
    none = common.sieve(keys.limit(0), "k").scalar()
    assert rows.filter(common.may_hold(none, "id")).isEmpty()


def test_scratch_goes_with_its_block(spark, sf_dir):
    """Nested blocks remove their own; what is read before the end stays whole."""
    with common.scratch(spark):
        outer = common.materialise(spark.range(5), "outer")
        with common.scratch(spark):
            assert op2_grace_dedup(spark, sf_dir).count() == 200
            inner = [p for kind, p in common._made[-1] if kind == "path"]
            assert inner and all(os.path.isdir(p) for p in inner)
        assert not any(os.path.exists(p) for p in inner) and outer.count() == 5
        path = common._made[-1][0][1]
    assert not os.path.exists(path) and not common._made
    with pytest.raises(ZeroDivisionError), common.scratch(spark):
        common.materialise(spark.range(5), "failed")
        path = common._made[-1][0][1]
        1 / 0  # noqa: B018
    assert not os.path.exists(path)


def test_a_hundred_thousand_rows_of_one_key(spark):
    """No window holds a key: slots are counted by task."""
    hot = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 5).cast("string")).alias("text"))
    others = spark.range(3_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    found = sharding.shard_rows(hot.unionByName(others).repartition(16), [1.0] * 8)
    slots = defaultdict(list)
    for r in found.select("shard", "slot").collect():
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == 103_000 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert found.filter("doc_id is null").select("shard").distinct().count() == 1
