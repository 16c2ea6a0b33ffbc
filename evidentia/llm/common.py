"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes in one Arrow batch, after which it ends with the row that it holds.
BATCH_BYTES = 4 << 20
#: Rows of narrow tables that one file holds.
FILE_ROWS = 100_000


def byte_size(value: str) -> int:
    """A size as Spark's settings spell it: a number of bytes, or one with b, k, m, g, t or p (or kb, mb, ..)."""
    found = re.fullmatch(r"(\d+)\s*(?:([kmgtp])b?|b)?", value.strip().lower())
    if not found:
        raise ValueError(f"not a size: {value}")
    return int(found[1]) << 10 * (" kmgtp".index(found[2]) if found[2] else 0)


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough that a batch of long texts fits a worker; a smaller bound stays.

    Spark has this setting for a session only, and reads it when a plan runs, so it is left in place."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = byte_size(spark.conf.get(key))
    if now > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.  Where none is set, a local master gets one of its own (tests); a cluster has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="evidentia-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Paths and tables that were made inside of `scratch`, by nesting.
_made: list[list[tuple[str, str]]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    noted("path", path)
    return path


def noted(kind: str, name: str) -> None:
    """Something that `scratch` is to remove: a path, or a table of the catalog."""
    if _made:
        _made[-1].append((kind, name))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What operators write inside is removed at the end, so their results must have been written or used by then."""
    _made.append([])
    try:
        yield
    finally:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        for kind, name in reversed(_made.pop()):
            if kind == "table":
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            else:
                path = hadoop(name)
                path.getFileSystem(conf).delete(path, True)


def materialise(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Cut the lineage: write a table to the shared folder and read it back.

    rows: where a bound is known, it is written in parts of a fair size rather than by the shuffle's."""
    path = new_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of a sieve: 128 kilobytes, whatever it holds.
SIEVE_BITS = 1 << 20


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """One row with a bitmap (array of long) of the keys' hashes, whose size is fixed.  See may_hold."""
    at = F.pmod(F.xxhash64(key), F.lit(SIEVE_BITS))
    bits = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    words = keys.select(F.floor(at / 64).alias("word"), bits.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = words.toArrow()  # at most as many rows as the bitmap has words
    held = np.zeros(SIEVE_BITS // 64, np.int64)
    held[found["word"].to_numpy()] = found["bits"].to_numpy()
    return keys.sparkSession.createDataFrame(pa.table({"sieve": pa.array([held], pa.list_(pa.int64()))}))


def may_hold(bitmap: Column, key: str | Column) -> Column:
    """Whether a key may be among those of the sieve; false only if it isn't."""
    at = F.pmod(F.xxhash64(key), F.lit(SIEVE_BITS))
    word = F.get(bitmap, F.floor(at / 64).cast("int"))
    return F.getbit(word, F.pmod(at, F.lit(64)).cast("int")) == 1


def utf8(column: str | Column) -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    bound_batches(df.sparkSession)
    return df.mapInArrow(function, schema)
