"""Streams of the events table, landed and read in several runs, against the same in batch SQL (2.13)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import new_folder
from ..streaming import runlog, sinks, state
from ..streaming import stories as s
from .registry import query, table

LATEST = "2024-01-25 00:00:00"
#: Parts in which the events land, one after another.
PARTS = 3


def land(spark, sf_dir: str, parts: int, part=None):
    """The path where the events land, and a step that writes the next part.  Parts are stretches of time with
    about equally many events, or what `part` numbers from 0."""
    events, path = table(spark, sf_dir, "events"), new_folder(spark)
    if part is None:
        at = F.unix_micros(F.col("ts").cast("timestamp"))
        bounds = events.select(at.alias("at")).approxQuantile("at", [k / parts for k in range(1, parts)], 0.001)
        part = sum((F.when(at > int(b), 1).otherwise(0) for b in bounds), F.lit(0))

    def step(k: int) -> None:
        events.filter(part == k).write.mode("append").parquet(path)

    return path, step


def in_runs(spark, sf_dir: str, sink: Callable[[DataFrame, str], object], parts: int | None = None, part=None, batches: bool = False):
    """What a sink gives after all parts have landed: each part is followed by a run from the same checkpoint; or,
    with `batches`, all land first and one run reads them file by file."""
    parts = parts or PARTS
    path, step = land(spark, sf_dir, parts, part)
    schema, out, found = table(spark, sf_dir, "events").schema, new_folder(spark), None
    reader = spark.readStream.schema(schema)
    for k in range(parts):
        step(k)
        if not batches or k == parts - 1:
            rows = (reader.option("maxFilesPerTrigger", 1) if batches else reader).parquet(path)
            found = sink(rows.withColumn("at", F.col("ts").cast("timestamp")), out)
    return found


@query("SELECT DISTINCT sha1('https://a.org/' || user_id || '/' || event_type) AS url_hash FROM events")
def strm_ingest(spark, sf_dir):
    """STRM-1: what stays within the watermark (90 days here, longer than the table) comes once."""

    def sink(rows, out):
        rows = rows.withColumn("url", F.concat(F.lit("http://www.a.org/"), "user_id", F.lit("//"), "event_type", F.lit("/")))
        return sinks.appended(s.ingest(rows, "at", "90 days").select("url_hash"), out)

    return in_runs(spark, sf_dir, sink)


@query(
    f"""SELECT event_id, strftime(date_trunc('second', CASE WHEN event_id % 50 = 0 OR ts > TIMESTAMP '{LATEST}' + INTERVAL 90 MINUTES
  THEN TIMESTAMP '{LATEST}' ELSE ts END), '%Y-%m-%d %H:%M:%S') AS at FROM events"""
)
def strm_event_time(spark, sf_dir):
    """STRM-2: times too early or too late become those of the collection."""

    def sink(rows, out):
        published = F.when(F.col("event_id") % 50 == 0, F.lit("1990-01-01").cast("timestamp")).otherwise(F.col("ts").cast("timestamp"))
        rows = rows.drop("at").withColumns({"published": published, "collected": F.lit(LATEST).cast("timestamp")})
        return sinks.appended(s.event_time(rows, "published", "collected").select("event_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at")), out)

    return in_runs(spark, sf_dir, sink)


@query(
    f"""WITH e AS (SELECT event_id, ts, event_id % {PARTS} AS part FROM events), m AS (SELECT part, max(ts) AS latest FROM e GROUP BY part),
k AS (SELECT p.part, (SELECT max(latest) FROM m WHERE m.part < p.part) AS mark FROM m p)
SELECT event_id, coalesce(ts < mark - INTERVAL 72 HOURS, false) AS late FROM e JOIN k USING (part)"""
)
def strm_late(spark, sf_dir):
    """STRM-2: what comes more than three days behind the runs before goes to a table of its own; here every
    run brings events of all times."""
    delay = F.make_dt_interval(hours=F.lit(72))
    kept, late = in_runs(spark, sf_dir, lambda rows, out: sinks.split_late(rows, "at", delay, out), part=F.col("event_id") % PARTS)
    return kept.select("event_id", F.lit(False).alias("late")).unionByName(late.select("event_id", F.lit(True).alias("late")))


@query(
    """WITH w AS (SELECT user_id, event_type, unnest(range(0, 12)) AS k, date_trunc('hour', ts) AS h FROM events)
SELECT user_id, epoch(h - to_hours(k))::BIGINT AS start, count(*) AS items, count(DISTINCT event_type) AS families FROM w GROUP BY ALL"""
)
def strm_trend(spark, sf_dir):
    """STRM-3: twelve hours, every hour, from hours that are merged by their key where they change in several runs."""

    def sink(rows, out):
        found = s.trend_hours(rows.withWatermark("at", "72 hours"), "user_id", "event_type")
        hours = sinks.merged(found, ["user_id", "start", "event_type"], out)
        return s.sliding(hours, "user_id", "event_type").select("user_id", F.unix_seconds("start").alias("start"), "items", "families")

    return in_runs(spark, sf_dir, sink)


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOURS THEN 0 ELSE 1 END AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS items FROM g GROUP BY user_id, session HAVING count(*) >= 3"""
)
def strm_bursts(spark, sf_dir):
    """STRM-4: sessions of three updates or more.  Sessions can grow together, so the table is replaced."""

    def sink(rows, out):
        found = s.bursts(rows.withWatermark("at", "72 hours"), "user_id")
        return sinks.replaced(found.select("user_id", F.unix_micros("session_window.start").alias("start"), "items"), out)

    return in_runs(spark, sf_dir, sink)


@query("SELECT event_id, c_mktsegment AS segment FROM events LEFT JOIN customer ON c_custkey = user_id")
def strm_enrich(spark, sf_dir):
    """STRM-5: events with a dimension."""
    dimension = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return in_runs(spark, sf_dir, lambda rows, out: sinks.appended(s.enrich_static(rows, dimension, "user_id").select("event_id", "segment"), out))


@query(
    """SELECT p.event_id AS post, s.event_id AS story FROM events p JOIN events s ON p.user_id = s.user_id
  AND p.event_type = 'click' AND s.event_type = 'view' AND p.ts >= s.ts AND p.ts <= s.ts + INTERVAL 72 HOURS"""
)
def strm_links(spark, sf_dir):
    """STRM-6: clicks with the views of the same user in the three days before."""

    def sink(rows, out):
        side = lambda kind, name: rows.filter(F.col("event_type") == kind).select(F.col("event_id").alias(name), F.col("user_id").alias("entity"), "at").withWatermark("at", "72 hours")
        return sinks.appended(s.link_posts(side("click", "post"), side("view", "story")).select("post", "story"), out)

    return in_runs(spark, sf_dir, sink)


@query("SELECT user_id, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') GROUP BY 1")
def strm_touched(spark, sf_dir):
    """STRM-7, by batches: stories that new items touch are built anew from all that is stored, and merged by key."""
    store = table(spark, sf_dir, "events")

    def sink(rows, out):
        def rebuilt(batch, number):
            found = s.touched(batch, store, "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
            sinks.merge_batch(found, out, ["user_id"])

        s.each_batch(rows.filter("event_type = 'purchase'"), rebuilt, f"{out}-checkpoint").awaitTermination()
        return spark.read.schema("user_id long, n long, ids long, bucket__ int").parquet(out).drop("bucket__")

    return in_runs(spark, sf_dir, sink)


@query(
    """WITH s AS (SELECT user_id AS story, ts, event_type AS status, lag(event_type) OVER w AS before, lag(ts) OVER w AS t0,
  count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 72 HOURS PRECEDING AND CURRENT ROW) AS recent
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type))
SELECT story, epoch_us(ts) AS at, before, status AS after, recent::INTEGER AS recent FROM s WHERE before <> status AND ts <= t0 + INTERVAL 72 HOURS"""
)
def strm_status_changes(spark, sf_dir):
    """STRM-7, RES-13: changes of status, from state that is dropped after three days of silence."""

    def sink(rows, out):
        observed = rows.select(F.col("user_id").alias("story"), "at", F.col("event_type").alias("status")).withWatermark("at", "1 hour")
        with state.rocksdb(spark):
            return sinks.appended(state.status_changes(observed), out)

    found = in_runs(spark, sf_dir, sink)
    return found.select("story", F.unix_micros("at").alias("at"), "before", "after", "recent")


@query(
    """WITH a AS (SELECT event_id AS event, ts AS at0, date_trunc('day', ts) + to_hours(12 + event_id % 24) AS start FROM events),
w AS (SELECT make_timestamp_ms(epoch_ms(max(ts) - INTERVAL 1 HOUR)) AS mark FROM events),
st AS (SELECT event, CASE WHEN at0 < start THEN 'UPCOMING' WHEN at0 <= start + INTERVAL 7 HOURS THEN 'LIVE' ELSE 'UNKNOWN' END AS status, start, at0, mark FROM a, w)
SELECT event, epoch_us(at0) AS at, status FROM st UNION ALL SELECT event, epoch_us(start), 'LIVE' FROM st WHERE status = 'UPCOMING' AND mark >= start
UNION ALL SELECT event, epoch_us(start + INTERVAL 7 HOURS), 'UNKNOWN' FROM st WHERE status <> 'UNKNOWN' AND mark > start + INTERVAL 7 HOURS"""
)
def strm_lifecycle(spark, sf_dir):
    """STRM-7, 8: announced events, their state, and what timers make of it up to the end of the stream."""

    def sink(rows, out):
        start = F.date_trunc("day", "at") + F.make_dt_interval(hours=(12 + F.col("event_id") % 24).cast("int"))
        told = rows.select(F.col("event_id").alias("event"), start.alias("start"), "at").withWatermark("at", "1 hour")
        return sinks.appended(state.lifecycle(told), out)

    return in_runs(spark, sf_dir, sink).select("event", F.unix_micros("at").alias("at"), "status")


def logged(spark, sf_dir, parts=None, batches=False):
    """The log of a stream's runs over the events, of which errors count as failures."""
    path = new_folder(spark)
    with runlog.RunLog(spark, path) as log:

        def sink(rows, out):
            counted = s.counted(rows, "run", F.col("event_type") != "error")
            log.wait(counted.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start())

        in_runs(spark, sf_dir, sink, parts, batches=batches)
    return runlog.read_runs(spark, path)


@query("SELECT count(*) AS rows, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS failed FROM events")
def strm_counters(spark, sf_dir):
    """STRM-9: the runs' counters, written by a listener while the stream passes."""
    return logged(spark, sf_dir).agg(*(F.sum(c).alias(c) for c in ("rows", "ok", "failed")))


@query(
    """WITH r AS (SELECT user_id AS query, strftime(ts, '%Y-%m-%d') AS run, max(ts) AS t, count(*) FILTER (event_type <> 'error' AND event_id % 3 > 0) AS ok,
  count(*) FILTER (event_type = 'error' OR event_id % 3 = 0) AS failed FROM events GROUP BY ALL),
f AS (SELECT query, last(ok ORDER BY t, run) AS ok, last(failed ORDER BY t, run) AS failed, max(t) AS last_run, max(t) FILTER (ok > 0) AS last_success FROM r GROUP BY query),
o AS (SELECT *, CASE WHEN failed = 0 THEN 'SUCCESS' WHEN ok = 0 THEN 'TOTAL_FAILURE' ELSE 'PARTIAL' END AS outcome FROM f)
SELECT query, outcome, epoch_us(last_run) AS last_run, coalesce(epoch_us(last_success), 0) AS last_success, ok + failed AS attempted, ok, failed,
 CASE WHEN last_success IS NULL THEN 'never' WHEN outcome = 'TOTAL_FAILURE' THEN 'failed'
  WHEN epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last_success) > 48 * 3600000000 THEN 'stale' ELSE 'current' END AS freshness, outcome <> 'SUCCESS' AS needs_attention FROM o"""
)
def agg_run_freshness(spark, sf_dir):
    """AGG-19: last run, last successful run and how fresh the data are; a day of a user's events is a run."""
    ok = ((F.col("event_type") != "error") & (F.col("event_id") % 3 > 0)).cast("long")
    runs = table(spark, sf_dir, "events").select(F.col("user_id").alias("query"), F.date_format("ts", "yyyy-MM-dd").alias("run"), F.col("ts").cast("timestamp").alias("at"), ok.alias("ok"), (1 - ok).alias("failed"))
    found = runlog.freshness(runs, F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return found.withColumns({"last_run": F.unix_micros("last_run"), "last_success": F.coalesce(F.unix_micros("last_success"), F.lit(0))})
