"""Data-quality checks over derived tables (2.15), each as findings of one shape."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import text
from ..operators import checks, evidence, feeds
from ..sources.scratch import keep
from . import newsroom
from .activity_queries import EVENTS_AS_OF, attempts
from .desk_queries import EVENTS, events
from .news_queries import ENRICHED, enriched
from .newsroom import ARTICLES, chosen
from .registry import query, table
from .shapes import ITEMS_SQL, as_of, items, pick
from .text_queries import norm
from .wire_queries import BOUTS, bouts, keyed_events, KEYS_SQL

CHECK_AS_OF = "1998-01-01 00:00:00"


def shown(findings):
    return findings.drop("detail")


@query(
    f"""WITH {EVENTS} SELECT 'ERROR' AS level, 'completed_before_start' AS "check", CAST(event AS VARCHAR) AS row_key FROM ev WHERE status = 'COMPLETED' AND coalesce(start, day) > TIMESTAMP '{CHECK_AS_OF}'
 UNION ALL SELECT 'WARN', 'stale_upcoming', CAST(event AS VARCHAR) FROM ev WHERE status = 'UPCOMING' AND date_diff('second', start, TIMESTAMP '{CHECK_AS_OF}') / 3600.0 >= 72
 UNION ALL SELECT 'WARN', 'status_without_schedule', CAST(event AS VARCHAR) FROM ev WHERE status IN ('LIVE', 'COMPLETED') AND start IS NULL
 UNION ALL SELECT 'WARN', 'official_conflict', CAST(event AS VARCHAR) FROM (SELECT event, unnest(conflicts) FROM ev)"""
)
def dq_events(spark, sf_dir):
    """DQ-3, 10"""
    rows = events(spark, sf_dir)
    return shown(checks.run_all([checks.event_status(rows, F.lit(CHECK_AS_OF).cast("timestamp")), checks.conflicts(rows)]))


@query(
    f"""WITH {ENRICHED}, t AS (SELECT id, CASE WHEN id % 6 = 0 THEN 'result' ELSE category END AS category, CASE WHEN id % 25 = 0 THEN NULL WHEN id % 25 = 1 THEN '' ELSE intent END AS intent, CASE WHEN id % 40 = 0 THEN TIMESTAMP '1990-05-05' ELSE t0 END AS t1, headline FROM (SELECT *, title AS headline FROM enriched))
SELECT 'ERROR' AS level, 'prediction_as_result' AS "check", CAST(id AS VARCHAR) AS row_key FROM t WHERE intent IN ('PREVIEW', 'PREDICTION') AND category = 'result' UNION ALL SELECT 'WARN', 'unclassified_intent', CAST(id AS VARCHAR) FROM t WHERE coalesce(intent, '') = ''
 UNION ALL SELECT 'WARN', 'implausible_date', CAST(id AS VARCHAR) FROM t WHERE t1 < TIMESTAMP '1993-11-12' OR t1 > TIMESTAMP '2000-01-01' + INTERVAL 90 MINUTES
 UNION ALL SELECT 'WARN', 'same_headline', substr({norm('headline')}, 1, 90) FROM t GROUP BY 3 HAVING count(*) > 1"""
)
def dq_articles(spark, sf_dir):
    """DQ-4, 6, 8, 13"""
    k = F.col("id")
    rows = keep(enriched(spark, sf_dir)).withColumns({"category": F.when(k % 6 == 0, F.lit("result")).otherwise(F.col("category")), "intent": F.when(k % 25 == 1, F.lit("")).when(k % 25 > 1, F.col("intent")), "at": F.when(k % 40 == 0, F.lit("1990-05-05").cast("timestamp")).otherwise(F.col("at"))})
    heads = rows.select(k.alias("story"), F.col("title").alias("headline"))
    return shown(checks.run_all([checks.results_from_predictions(rows), checks.unclassified(rows), checks.bad_dates(rows, "at", "id", F.lit("2000-01-01").cast("timestamp")), checks.near_headlines(heads)]))


@query(
    f"""WITH {ITEMS_SQL} SELECT 'WARN' AS level, 'copies_only' AS "check", CAST(story AS VARCHAR) AS row_key FROM stories WHERE source_count > 0 AND independent_count = 0
 UNION ALL SELECT 'ERROR', 'independent_over_total', CAST(story AS VARCHAR) FROM stories WHERE independent_count > source_count - (story % 5)
 UNION ALL SELECT 'WARN', 'articles_without_sources', CAST(story AS VARCHAR) FROM stories WHERE articles > 0 AND source_count - (story % 5) = 0
 UNION ALL SELECT 'ERROR', 'story_without_sources', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
 UNION ALL SELECT 'WARN', 'stale_breaking', CAST(story AS VARCHAR) FROM stories WHERE story % 3 = 0 AND date_diff('second', last_seen, TIMESTAMP '1999-06-01 06:00:00') / 3600.0 > 48"""
)
def dq_findings(spark, sf_dir):
    """DQ-5, 7, 11; counts are lowered by up to four so that the checks have something to find."""
    stories = evidence.rebuild_stories(items(spark, sf_dir), as_of())
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("story"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("story"))
    wrong = stories.withColumns({"source_count": F.col("source_count") - F.col("story") % 5, "is_breaking": F.col("story") % 3 == 0})
    return shown(checks.run_all([
        checks.failing(stories, (F.col("source_count") > 0) & (F.col("independent_count") == 0), "WARN", "copies_only", F.col("story"), F.col("source_count")),
        checks.source_counts(wrong), checks.orphans(orders, lines, "story", "ERROR", "story_without_sources"), checks.breaking_too_old(wrong, as_of()),
    ]))


@query(
    f"""WITH {KEYS_SQL}, {BOUTS}, c AS (SELECT c_mktsegment AS division, c_nationkey AS position, c_acctbal > 9000 AS crown FROM customer)
SELECT 'ERROR' AS level, 'duplicate_event' AS "check", keys[1] AS row_key FROM ks GROUP BY keys[1] HAVING count(*) > 1 UNION ALL SELECT 'ERROR', 'duplicate_entity', {norm("p_name || ' ' || p_brand")} FROM part GROUP BY 3 HAVING count(*) > 1
 UNION ALL SELECT 'ERROR', 'multiple_champions', division FROM c WHERE crown GROUP BY 3 HAVING count(*) > 1 UNION ALL SELECT 'ERROR', 'duplicate_position', division || '|' || position FROM c WHERE position > 0 GROUP BY 3 HAVING count(*) > 1
 UNION ALL SELECT 'ERROR', 'bout_contradiction', event || '|' || pair_key FROM bo WHERE (level = 'official_card') <> (id % 9 = 0) UNION ALL SELECT 'ERROR', 'orphan_bout', CAST(event AS VARCHAR) FROM bo WHERE event NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"""
)
def dq_entities(spark, sf_dir):
    """DQ-1, 2, 9, 12, 17"""
    ranks = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("division"), F.col("c_nationkey").alias("position"), (F.col("c_acctbal") > 9000).alias("is_champion"))
    card = bouts(spark, sf_dir).withColumn("official_status", F.when(F.col("id") % 9 == 0, F.lit("official")).otherwise("unofficial"))
    solvent = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("event"))
    return shown(checks.run_all([
        checks.duplicates(keyed_events(spark, sf_dir), F.element_at("keys", 1), "ERROR", "duplicate_event"), checks.duplicates(table(spark, sf_dir, "part"), text.normalize(F.concat_ws(" ", "p_name", "p_brand")), "ERROR", "duplicate_entity"),
        checks.rankings(ranks), checks.bout_contradictions(card), checks.orphans(card, solvent, "event", "ERROR", "orphan_bout"),
    ]))


ADDRESSES = ["", "ftp://a.org/x", "http:///path", "not a url"]


@query(
    f"""WITH u AS (SELECT 'page' AS t, page_id AS k, CASE WHEN page_id % 10 < 4 THEN {chosen('page_id % 10', ADDRESSES)} ELSE url END AS url FROM pages UNION ALL SELECT 'article', id, CASE WHEN id % 100 = 0 THEN NULL ELSE url END FROM (WITH {ARTICLES} SELECT * FROM art) UNION ALL SELECT 'part', p_partkey, p_name FROM part)
SELECT 'ERROR' AS level, 'malformed_url' AS "check", k::VARCHAR AS row_key, t FROM u WHERE url IS NULL OR NOT regexp_matches(url, '(?i)^https?://[^/?#]+')"""
)
def dq_malformed_urls(spark, sf_dir):
    """DQ-14, URL-4, in three tables."""
    k = F.col("page_id")
    pages = table(spark, sf_dir, "pages").withColumn("url", F.when(k % 10 < 4, pick(k % 10, ADDRESSES)).otherwise(F.col("url")))
    news = newsroom.articles(spark, sf_dir).withColumn("url", F.when(F.col("id") % 100 > 0, F.col("url")))
    found = {"page": checks.bad_urls(pages, "url", "page_id"), "article": checks.bad_urls(news, "url", "id"), "part": checks.bad_urls(table(spark, sf_dir, "part"), "p_name", "p_partkey")}
    return checks.run_all([df.drop("detail").withColumn("t", F.lit(name)) for name, df in found.items()])


DECLARED = StructType([StructField("n_nationkey", StringType()), StructField("n_name", StringType()), StructField("n_regionkey", LongType()), StructField("n_population", LongType())])


@query(
    f"""WITH c AS (SELECT column_name AS c, column_type AS t FROM (DESCRIBE nation)), d(c, t) AS (VALUES ('n_nationkey', 'VARCHAR'), ('n_name', 'VARCHAR'), ('n_regionkey', 'BIGINT'), ('n_population', 'BIGINT')),
s AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), b AS (SELECT (SELECT count(*) FROM s) AS whole, (SELECT count(*) FROM s WHERE user_id % 17 <> 0) AS part)
SELECT 'ERROR' AS level, 'schema_drift' AS "check", 'nation.' || d.c AS row_key FROM d LEFT JOIN c ON c.c = d.c WHERE c.t IS NULL OR CASE c.t WHEN 'INTEGER' THEN 'INT' ELSE c.t END <> d.t UNION ALL SELECT 'WARN', 'schema_drift', 'nation.' || c.c FROM c WHERE c.c NOT IN (SELECT c FROM d)
 UNION ALL SELECT 'ERROR', 'health_short', 'total' FROM b WHERE whole <> part"""
)
def dq_schema(spark, sf_dir):
    """DQ-15, 16: drift from a declared schema, and health states that don't add up where one is left out."""
    health = feeds.source_health(attempts(spark, sf_dir), F.lit(EVENTS_AS_OF).cast("timestamp"))
    states, sources = health.groupBy("state").agg(F.count(F.lit(1)).alias("n")), health.select("source")
    return shown(checks.run_all([
        checks.schema_drift(table(spark, sf_dir, "nation"), DECLARED, "nation"), checks.reconcile(states, "n", sources, "health_whole"), checks.reconcile(states.filter("state <> 'disabled'"), "n", sources, "health_short"),
    ]))
