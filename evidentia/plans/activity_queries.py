"""Queries over activity, rankings and state (2.9 to 2.13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feeds, resolve
from .registry import query, table
from .shapes import pick

EVENTS_AS_OF = "2024-01-31 00:00:00"


def attempts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("source"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") != "error").alias("ok"), F.lit(1).alias("items"), (F.col("user_id") % 17 != 0).alias("enabled"))


@query(
    f"""WITH l AS (SELECT user_id AS source, max(ts) AS last_attempt, max(ts) FILTER (event_type <> 'error') AS last_success, count(*) FILTER (event_type <> 'error') AS items, user_id % 17 <> 0 AS enabled FROM events GROUP BY user_id),
f AS (SELECT user_id AS source, count(*) FILTER (event_type = 'error' AND (last_success IS NULL OR ts > last_success)) AS failures FROM events JOIN l ON user_id = source GROUP BY user_id)
SELECT source, items, failures, CASE WHEN NOT enabled THEN 'disabled' WHEN last_success IS NULL THEN 'never_worked' WHEN failures >= 3 THEN 'failing' WHEN failures > 0 THEN 'unstable'
 WHEN date_diff('second', last_success, TIMESTAMP '{EVENTS_AS_OF}') / 3600.0 > 48 THEN 'stale' ELSE 'working' END AS state FROM l JOIN f USING (source)"""
)
def agg_source_health(spark, sf_dir):
    return feeds.source_health(attempts(spark, sf_dir), F.lit(EVENTS_AS_OF).cast("timestamp")).select("source", "items", "failures", "state")






def snapshots(spark, sf_dir):
    """Customers ranked by a year's revenue within their segment; the first is the champion."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    revenue = o.groupBy(F.col("c_mktsegment").alias("division"), F.year("o_orderdate").alias("ranking_date"), F.col("c_name").alias("name")).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("division", "ranking_date").orderBy(F.col("revenue").desc(), "name"))
    return revenue.withColumn("position", place).filter(F.col("position") <= 15).select("division", "name", (F.col("position") - 1).alias("position"), (F.col("position") == 1).alias("is_champion"), "ranking_date")


SNAPSHOTS_SQL = """
s AS (SELECT division, name, p - 1 AS position, p = 1 AS champ, y FROM (SELECT *, row_number() OVER (PARTITION BY division, y ORDER BY revenue DESC, name) AS p FROM (
 SELECT c_mktsegment AS division, year(o_orderdate) AS y, c_name AS name, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)) WHERE p <= 15),
d AS (SELECT division, y, lag(y) OVER (PARTITION BY division ORDER BY y) AS py FROM (SELECT DISTINCT division, y FROM s)),
cur AS (SELECT s.* FROM s JOIN d USING (division, y) WHERE py IS NOT NULL),
prev AS (SELECT s.division, s.name, s.position, s.champ, d.y FROM s JOIN d ON s.division = d.division AND s.y = d.py)
"""


@query(
    f"""WITH {SNAPSHOTS_SQL}, c AS (SELECT coalesce(a.division, b.division) AS division, coalesce(a.name, b.name) AS name, coalesce(a.y, b.y)::INTEGER AS ranking_date, coalesce(b.position, -1)::INTEGER AS previous_position, coalesce(a.position, -1)::INTEGER AS new_position,
 CASE WHEN b.name IS NULL THEN CASE WHEN a.champ THEN 'new_champion' ELSE 'new_entry' END WHEN a.name IS NULL THEN 'exit' WHEN a.champ <> b.champ THEN CASE WHEN a.champ THEN 'new_champion' ELSE 'champion_change' END
  WHEN a.position < b.position THEN 'up' WHEN a.position > b.position THEN 'down' END AS change_type
 FROM cur a FULL JOIN prev b ON a.division = b.division AND a.name = b.name AND a.y = b.y)
SELECT *, CASE WHEN change_type IN ('up','down') THEN abs(new_position - previous_position) ELSE -1 END::INTEGER AS positions_moved FROM c WHERE change_type IS NOT NULL"""
)
def agg_rank_changes(spark, sf_dir):
    # no nulls in the compared columns: -1 for a place that isn't there
    return resolve.rank_changes(snapshots(spark, sf_dir)).na.fill(-1, ["previous_position", "new_position", "positions_moved"])


CHANGES_SQL = f"""{SNAPSHOTS_SQL}, ch AS (SELECT coalesce(a.division, b.division) AS division, coalesce(a.name, b.name) AS name, coalesce(a.y, b.y)::INTEGER AS ranking_date, b.position AS p, a.position AS n,
 CASE WHEN b.name IS NULL THEN CASE WHEN a.champ THEN 'new_champion' ELSE 'new_entry' END WHEN a.name IS NULL THEN 'exit' WHEN a.champ <> b.champ THEN CASE WHEN a.champ THEN 'new_champion' ELSE 'champion_change' END
  WHEN a.position < b.position THEN 'up' WHEN a.position > b.position THEN 'down' END AS change_type FROM cur a FULL JOIN prev b ON a.division = b.division AND a.name = b.name AND a.y = b.y)"""


@query(
    f"""WITH {CHANGES_SQL} SELECT division, name, ranking_date, CASE change_type WHEN 'new_entry' THEN name || ' enters the ' || division || ' rankings at #' || n WHEN 'exit' THEN name || ' drops out of the ' || division || ' rankings (was #' || p || ')'
 WHEN 'new_champion' THEN name || ' is listed as ' || division || ' champion' WHEN 'champion_change' THEN name || ' is no longer listed as ' || division || ' champion'
 ELSE name || ' moves ' || change_type || ' in ' || division || ': #' || p || ' -> #' || n END AS sentence FROM ch WHERE change_type IS NOT NULL"""
)
def agg_rank_sentences(spark, sf_dir):
    """AGG-11: each movement in words."""
    return resolve.rank_changes(snapshots(spark, sf_dir)).select("division", "name", "ranking_date", resolve.describe_change().alias("sentence"))


@query(f"WITH {SNAPSHOTS_SQL} SELECT division, name, y::INTEGER AS ranking_date, position::INTEGER AS position, coalesce(lag(position) OVER (PARTITION BY division, name ORDER BY y), -1)::INTEGER AS previous_position FROM s")
def win_rank_history(spark, sf_dir):
    """WIN-3: every place of a name over the years with the one before it."""
    found = resolve.rank_history(snapshots(spark, sf_dir))
    return found.select("division", "name", "ranking_date", F.col("position").cast("int").alias("position"), F.coalesce("previous_position", F.lit(-1)).cast("int").alias("previous_position"))


@query(f"WITH {SNAPSHOTS_SQL} SELECT name, max(y)::INTEGER AS as_of, last(position ORDER BY y)::INTEGER AS position FROM s GROUP BY name")
def res_latest_rank(spark, sf_dir):
    return resolve.latest_rank(snapshots(spark, sf_dir)).select("name", "as_of", F.col("position").cast("int").alias("position"))



@query(
    """SELECT p_name || '|' || p_brand AS k, first(p_partkey ORDER BY p_retailprice DESC, p_partkey) AS keeper, sum(p_size)::BIGINT AS p_size, max(p_retailprice) AS p_retailprice, count(*) AS merged FROM part GROUP BY 1"""
)
def res_merge_duplicates(spark, sf_dir):
    """RES-2"""
    rows = table(spark, sf_dir, "part").select(F.concat_ws("|", "p_name", "p_brand").alias("k"), F.col("p_partkey").alias("keeper"), F.col("p_size").cast("long").alias("p_size"), "p_retailprice")
    return resolve.merge_duplicates(rows.withColumn("price", F.col("p_retailprice")), "k", [-F.col("price"), F.col("keeper")], ["keeper"], ["p_size"], ["p_retailprice"])


def observations(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.select(
        F.col("l_suppkey").alias("event"),
        (F.col("l_partkey") % 5).cast("string").alias("pair_key"),
        (F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(secs=F.col("l_orderkey") * 8 + F.col("l_linenumber"))).alias("observed_at"),
        pick(F.col("l_linenumber").cast("long"), resolve.EVIDENCE).alias("evidence_level"),
        F.col("l_returnflag").alias("status"),
        F.when(F.col("l_linestatus") == "O", F.col("l_linestatus")).alias("weight_class"),
        F.lit(None).cast("string").alias("segment"),
    )


OBSERVED_SQL = """o AS (SELECT l_suppkey AS event, CAST(l_partkey % 5 AS VARCHAR) AS pair_key, l_shipdate + to_seconds(l_orderkey * 8 + l_linenumber) AS t0, l_linenumber % 5 AS s, l_returnflag AS status,
 CASE WHEN l_linestatus = 'O' THEN 'O' END AS weight_class FROM lineitem)"""


@query(
    f"""WITH {OBSERVED_SQL} SELECT event, pair_key, last(status ORDER BY s, t0, status) AS status, last(weight_class ORDER BY s, t0) FILTER (weight_class IS NOT NULL) AS weight_class,
 (['rumor','social','report','major_report','official_card'])[max(s) + 1] AS evidence_level, CASE WHEN max(s) = 4 THEN 'official' ELSE 'unofficial' END AS official_status FROM o GROUP BY ALL"""
)
def res_fold_bouts(spark, sf_dir):
    return resolve.fold_bouts(observations(spark, sf_dir)).select("event", "pair_key", "status", "weight_class", "evidence_level", "official_status")


@query(
    f"""WITH {OBSERVED_SQL}, c AS (SELECT *, lag(status) OVER (PARTITION BY event, pair_key ORDER BY t0, status) AS before FROM o)
SELECT event, pair_key, 'status' AS change_type, first(before ORDER BY t0, before) AS before, status AS after FROM c WHERE before <> status GROUP BY event, pair_key, status"""
)
def res_bout_changes(spark, sf_dir):
    return resolve.bout_changes(observations(spark, sf_dir), "status").drop("detected_at")


@query(
    """WITH RECURSIVE l AS (SELECT p_partkey AS id, p_partkey // 3 AS target FROM part WHERE p_partkey % 4 <> 0 AND p_partkey // 3 <> p_partkey),
w(id, target) AS (SELECT id, target FROM l UNION ALL SELECT w.id, l.target FROM w JOIN l ON w.target = l.id) SELECT id, min(target) AS target FROM w GROUP BY id"""
)
def join_redirects(spark, sf_dir):
    """JOIN-14: every chain leads to smaller ids, so its end is its smallest target."""
    from ..sources.scratch import keep

    parts = table(spark, sf_dir, "part").filter("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 3).alias("target"))
    return resolve.follow_redirects(parts, keep)


@query(
    """WITH e AS (SELECT o_orderkey AS event, o_orderdate AS start, o_orderkey % 3 = 0 AS listed FROM orders),
v AS (SELECT l_orderkey AS event, CASE l_returnflag WHEN 'R' THEN 'cancelled' WHEN 'A' THEN 'completed' ELSE 'postponed' END AS kind, l_shipdate AS t0, l_suppkey % 2 = 0 AS reliable, l_suppkey % 5 = 0 AS official FROM lineitem),
a AS (SELECT event, count(*) FILTER (kind='cancelled' AND reliable) AS c, count(*) FILTER (kind='cancelled' AND reliable AND official) AS oc, count(*) FILTER (kind='postponed' AND reliable) AS p,
 count(*) FILTER (kind='postponed' AND reliable AND official) AS op, max(t0) FILTER (kind='completed' AND reliable) AS done FROM v GROUP BY event),
j AS (SELECT e.*, coalesce(c,0) AS c, coalesce(oc,0) AS oc, coalesce(p,0) AS p, coalesce(op,0) AS op, done FROM e LEFT JOIN a USING (event)),
k AS (SELECT *, CASE WHEN listed THEN oc > 0 ELSE c > 0 END AS cc, CASE WHEN listed THEN op > 0 ELSE p > 0 END AS pp FROM j)
SELECT event, CASE WHEN cc THEN 'CANCELLED' WHEN pp THEN 'POSTPONED' WHEN done >= start THEN 'COMPLETED' WHEN TIMESTAMP '1997-06-01 03:00:00' < start THEN 'UPCOMING'
 WHEN TIMESTAMP '1997-06-01 03:00:00' <= start + INTERVAL 7 HOURS THEN 'LIVE' ELSE 'UNKNOWN' END AS status, listed AND ((c > 0 AND NOT cc) OR (p > 0 AND NOT pp)) AS has_conflict FROM k"""
)
def res_event_lifecycle(spark, sf_dir):
    events = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event"), F.col("o_orderdate").cast("timestamp").alias("start"), F.lit(None).cast("timestamp").alias("end"), F.to_date("o_orderdate").alias("event_date"), (F.col("o_orderkey") % 3 == 0).alias("official_listed"))
    proof = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("event"),
        F.when(F.col("l_returnflag") == "R", F.lit("cancelled")).when(F.col("l_returnflag") == "A", "completed").otherwise("postponed").alias("kind"),
        F.col("l_shipdate").cast("timestamp").alias("at"),
        (F.col("l_suppkey") % 2 == 0).alias("reliable"),
        (F.col("l_suppkey") % 5 == 0).alias("official"),
    )
    return resolve.lifecycle(events, proof, F.lit("1997-06-01 03:00:00").cast("timestamp")).select("event", "status", "has_conflict")


COUNTDOWN_AS_OF = "2024-01-10 12:00:00"


@query(
    f"""WITH s AS (SELECT event_id, epoch(date_trunc('second', ts))::BIGINT - epoch(TIMESTAMP '{COUNTDOWN_AS_OF}')::BIGINT AS s FROM events)
SELECT event_id, s // 86400 AS days, s % 86400 // 3600 AS hours, s % 3600 // 60 AS minutes FROM s WHERE s > 0"""
)
def dt_countdown(spark, sf_dir):
    """DT-8, to whole seconds."""
    from ..functions.timefn import countdown

    start = F.date_trunc("second", F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select("event_id", countdown(start, F.lit(COUNTDOWN_AS_OF).cast("timestamp")).alias("c")).filter("c is not null")
    return rows.select("event_id", "c.days", "c.hours", "c.minutes")


@query("SELECT user_id AS entity, count(DISTINCT event_id) AS mentions, strftime(max(ts), '%Y-%m-%d') AS last_day FROM events GROUP BY user_id")
def ent_mentions(spark, sf_dir):
    """ENT-7"""
    from ..operators.entities import mention_counts

    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.array("user_id").alias("entities"))
    return mention_counts(rows).select("entity", "mentions", F.date_format("last_mentioned", "yyyy-MM-dd").alias("last_day"))




@query(
    """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'ESTABLISHED_JOURNALIST' WHEN 'STANDARD' THEN 'COACH_TEAM' ELSE 'UNKNOWN' END AS source_type,
 CASE p_type WHEN 'ECONOMY' THEN 0.8 WHEN 'STANDARD' THEN 0.5 ELSE 0.3 END::DOUBLE AS weight FROM part"""
)
def cls_source_types(spark, sf_dir):
    """CLS-12: labels of several vocabularies as source types."""
    from ..operators.classify import reliability, source_type

    label = F.when(F.col("p_type") == "ECONOMY", F.lit(" trusted journalist ")).when(F.col("p_type") == "STANDARD", "Coach / Team").otherwise(F.col("p_type"))
    rows = table(spark, sf_dir, "part").select("p_partkey", source_type(label).alias("source_type"))
    return rows.withColumn("weight", reliability(F.col("source_type")))
