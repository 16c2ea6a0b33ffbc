"""Streaming forms (STRM-*): the batch operators over unbounded tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.timefn import sanitise
from ..functions.url import url_hash


def ingest(stream: DataFrame, at: str = "published_at", delay: str = "72 hours") -> DataFrame:
    """STRM-1: nothing twice within the watermark."""
    return stream.withColumn("url_hash", url_hash(F.col("url"))).withWatermark(at, delay).dropDuplicatesWithinWatermark(["url_hash"])


def event_time(stream: DataFrame, published: str, collected: str, delay: str = "72 hours") -> DataFrame:
    """STRM-2: implausible times become collection times before the watermark sees them."""
    return stream.withColumn("at", sanitise(F.col(published), F.col(collected), F.col(collected))).withWatermark("at", delay)


def trend_hours(stream: DataFrame, key: str, family: str, slide: str = "1 hour") -> DataFrame:
    """STRM-3: activity per story, stretch and family, of which `sliding` makes the windows.  A state for each
    stretch, where sliding windows would have as many as a window has stretches."""
    rows = stream.groupBy(F.window("at", slide).alias("w"), key, family).agg(F.count(F.lit(1)).alias("items"))
    return rows.select(key, F.col("w.start").alias("start"), family, "items")


def sliding(hours: DataFrame, key: str, family: str, length: str = "12 hours", slide: str = "1 hour") -> DataFrame:
    """(key, start, items, families): the windows over what `trend_hours` counted, families exactly.  A story's stretches
    are shuffled once, and its windows made where they are."""
    width, step = (F.expr(f"timestampdiff(MICROSECOND, timestamp '1970-01-01', timestamp '1970-01-01' + interval {x})") for x in (length, slide))
    at = F.unix_micros("start")
    rows = hours.repartition(key).withColumn("start", F.explode(F.sequence(at - width + step, at, step)))
    each = rows.groupBy(key, "start", family).agg(F.sum("items").alias("items"))
    found = each.groupBy(key, "start").agg(F.sum("items").alias("items"), F.count(family).alias("families"))
    return found.withColumn("start", F.timestamp_micros("start"))


def trend_windows(stream: DataFrame, key: str, family: str, length: str = "12 hours", slide: str = "1 hour") -> DataFrame:
    """STRM-3: sliding activity per story; families by sketch, as exact distinct counts can't be kept."""
    return stream.groupBy(F.window("at", length, slide), key).agg(F.count(F.lit(1)).alias("items"), F.approx_count_distinct(family).alias("families"))


def bursts(stream: DataFrame, key: str, gap: str = "2 hours", least: int = 3) -> DataFrame:
    """STRM-4: sessions of updates that follow closely."""
    return stream.groupBy(F.session_window("at", gap), key).agg(F.count(F.lit(1)).alias("items")).filter(F.col("items") >= least)


def enrich_static(stream: DataFrame, dimension: DataFrame, on: str) -> DataFrame:
    """STRM-5: a stream with a dimension that may be edited between batches."""
    return stream.join(dimension, on, "left")


def link_posts(posts: DataFrame, stories: DataFrame, entity: str = "entity", hours: int = 72) -> DataFrame:
    """STRM-6: posts with stories of the same entity seen up to that long before; both sides have watermarks."""
    p, s = posts.alias("p"), stories.alias("s")
    near = F.expr(f"p.{entity} = s.{entity} and p.at >= s.at and p.at <= s.at + interval {hours} hours")
    return p.join(s, near).select("p.post", "s.story", F.col("p.at").alias("at"))


def each_batch(stream: DataFrame, function: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """STRM-7: touched stories are rebuilt by the batch operators."""
    return stream.writeStream.foreachBatch(function).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def touched(batch: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """All stored items of the keys that a batch touches."""
    return store.join(batch.select(key).distinct(), key, "left_semi")


def counted(stream: DataFrame, name: str, ok: Column) -> DataFrame:
    """STRM-9: per-batch counters for the run log, without another pass."""
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"))
