"""Tables that streams of any number of batches write: appended, merged by key, replaced, or split by lateness.

Every sink is idempotent: a batch that is repeated after a failure leaves the table as the first time."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import new_folder

#: Parts of a table that is merged by key; a batch rewrites those that its keys fall into.
BUCKETS = 16


def run(stream: DataFrame, path: str, mode: str, write) -> None:
    """Everything that is there now, batch by batch; the checkpoint lies beside the table."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True)
    writer.foreachBatch(write).start().awaitTermination()


def _read(stream: DataFrame, path: str, extra: str = "") -> DataFrame:
    """The table, also where no batch has come yet."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    try:
        return stream.sparkSession.read.schema(fields + extra).parquet(path).select(*(F.col(f"`{c}`") for c in stream.columns))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return stream.sparkSession.createDataFrame([], stream.schema)


def appended(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Rows that are final when they come: one folder a batch, so that a repeated batch replaces itself."""
    path = path or new_folder(stream.sparkSession)
    run(stream, path, "append", lambda rows, number: rows.write.parquet(f"{path}/batch__={number}", mode="overwrite"))
    return _read(stream, path)


def merge_batch(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """Put a batch's rows in the place of those of the same keys.

    The table lies in buckets by key.  The batch's buckets are written anew, from its rows and the stored ones of
    other keys; the rest of the table isn't read.  Of rows that repeat a key within a batch the
    largest by all other columns stays."""
    spark = rows.sparkSession
    rest = [c for c in rows.columns if c not in keys]
    once = rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r__")).select(*keys, *(F.col(f"r__.`{c}`").alias(c) for c in rest)) if rest else rows.distinct()
    once = once.select(*rows.columns).withColumn("bucket__", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
    try:
        if once.isEmpty():
            return
        try:
            stored = spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            out = once
        else:
            beside = stored.join(once.select("bucket__").distinct(), "bucket__", "left_semi")
            same = [F.col(f"s.`{k}`").eqNullSafe(F.col(f"o.`{k}`")) for k in keys]
            kept = beside.alias("s").join(once.select(*keys, "bucket__").alias("o"), [F.col("s.bucket__") == F.col("o.bucket__"), *same], "left_anti")
            out = once.unionByName(kept.select(*once.columns))
        out.repartition("bucket__").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket__").parquet(path)
    finally:
        once.unpersist()


def merged(stream: DataFrame, keys: list[str], path: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """A stream in update mode: a key's row is the one of the latest batch that had it."""
    path = path or new_folder(stream.sparkSession)
    run(stream, path, "update", lambda rows, _: merge_batch(rows, path, keys, buckets))
    return _read(stream, path, ", bucket__ int")


def replaced(stream: DataFrame, path: str | None = None) -> DataFrame:
    """A stream in complete mode: the table is what the latest batch gives.  Each batch has a folder of its own, so
    that readers of the one before aren't disturbed; the largest batch number counts."""
    spark, path = stream.sparkSession, path or new_folder(stream.sparkSession)
    run(stream, path, "complete", lambda rows, number: rows.write.parquet(f"{path}/batch__={number}", mode="overwrite"))
    batches = _read(stream, path, ", batch__ long")
    if not batches.inputFiles():
        return batches
    every = spark.read.option("basePath", path).parquet(path)
    latest = every.agg(F.max("batch__")).first()[0]  # from the folders' names
    return batches.limit(0) if latest is None else every.filter(F.col("batch__") == latest).select(*stream.columns)


def split_late(stream: DataFrame, at: str, delay: Column, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """STRM-2: (kept, late).  A row is late if its time lies further than the delay behind the latest time of the
    batches before its own, which is where their watermark stood.

    Each batch leaves its latest time in a table of one row a batch, so a repeated batch sees the same mark."""
    spark, path = stream.sparkSession, path or new_folder(stream.sparkSession)
    marks = "batch__ long, latest timestamp"

    def write(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            rows.agg(F.max(at).alias("latest")).write.parquet(f"{path}/marks/batch__={number}", mode="overwrite")
            mark = spark.read.schema(marks).parquet(f"{path}/marks").filter(F.col("batch__") < number).agg(F.max("latest")).first()[0]
            late = F.coalesce(F.col(at) < F.lit(mark).cast("timestamp") - delay, F.lit(False))
            for name, test in (("kept", ~late), ("late", late)):
                rows.filter(test).write.parquet(f"{path}/{name}/batch__={number}", mode="overwrite")
        finally:
            rows.unpersist()

    run(stream, path, "append", write)
    return _read(stream, f"{path}/kept"), _read(stream, f"{path}/late")
