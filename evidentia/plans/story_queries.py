"""Queries over stories: evidence, status, scores, feeds (2.4, 2.9, 2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cards, checks, evidence, feeds
from ..operators.matching import first_by
from .registry import query, table
from .shapes import BREAKING_SQL, ITEMS_SQL, as_of, items

STATUS = "story, status, source_count, independent_count, social_count, speculation, category"


@query(f"WITH {ITEMS_SQL} SELECT story, source_count, independent_count, social_count, credible_accounts, copied_families FROM counts")
def agg_source_counts(spark, sf_dir):
    return evidence.source_counts(evidence.build_evidence(items(spark, sf_dir))).drop("better_sources", "evidence_rows")


@query(f"WITH {ITEMS_SQL} SELECT {STATUS} FROM stories")
def agg_story_status(spark, sf_dir):
    return evidence.rebuild_stories(items(spark, sf_dir), as_of()).selectExpr(*STATUS.split(", "))


@query(f"WITH {ITEMS_SQL} SELECT story, support_score, trend_score, relevance, CASE WHEN relevance >= 70 THEN 'HIGH' WHEN relevance >= 55 THEN 'ELEVATED' WHEN relevance >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM stories")
def agg_story_scores(spark, sf_dir):
    return evidence.rebuild_stories(items(spark, sf_dir), as_of()).select("story", "support_score", "trend_score", "relevance", "band")


@query(f"WITH {ITEMS_SQL} SELECT story, category FROM dominant")
def agg_dominant_category(spark, sf_dir):
    return evidence.dominant_category(items(spark, sf_dir))


@query(f"WITH {ITEMS_SQL} SELECT story, has_conflict, credible_disagreement, is_moving, origin_type FROM joined")
def agg_conflicts(spark, sf_dir):
    return evidence.with_conflicts(evidence.item_facts(items(spark, sf_dir), as_of())).select("story", "has_conflict", "credible_disagreement", "is_moving", "origin_type")



@query(f"WITH {ITEMS_SQL} SELECT story, status, relevance FROM stories WHERE relevance >= 55 ORDER BY relevance DESC, last_seen DESC, story LIMIT 60")
def flagship_feed(spark, sf_dir):
    """The most relevant important stories: the top 60 are the feed."""
    stories = evidence.rebuild_stories(items(spark, sf_dir), as_of())
    return feeds.feed(stories, "IMPORTANT", "Most Relevant", limit=60).select("story", "status", "relevance")


@query(
    f"""WITH {ITEMS_SQL}, s AS (SELECT story, relevance, last_seen, CASE WHEN {BREAKING_SQL} THEN '1 breaking'
 WHEN relevance >= 55 THEN '2 important' WHEN status IN ('RUMOR','UNVERIFIED','FIGHTER_CLAIM') THEN '3 rumors' WHEN is_moving THEN '4 developing' WHEN is_trending THEN '5 trending' ELSE '6 latest' END AS section FROM stories),
r AS (SELECT section, story, row_number() OVER (PARTITION BY section ORDER BY relevance DESC, last_seen DESC, story) AS place FROM s) SELECT section, story, place::INTEGER AS place FROM r WHERE place <= 10"""
)
def win_dashboard_sections(spark, sf_dir):
    return feeds.sections(evidence.rebuild_stories(items(spark, sf_dir), as_of()), 10).select("section", "story", "place")




@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def snk_first_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber")
    return first_by(rows, ["l_suppkey"], [F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")]).drop("l_shipdate")


@query(f"WITH {ITEMS_SQL}, n AS (SELECT story, family, count(*) AS items, max(engagement) AS best FROM items GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY story ORDER BY items DESC, family) AS r FROM n) SELECT story, family, items FROM r WHERE r = 1")
def win_best_family(spark, sf_dir):
    """WIN-1: the best candidate of each story, by aggregate instead of a window."""
    n = items(spark, sf_dir).groupBy("story", "family").agg(F.count(F.lit(1)).alias("items"))
    return first_by(n, ["story"], [-F.col("items"), F.col("family")]).select("story", "family", "items")


@query(
    f"""WITH {ITEMS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY story ORDER BY t0, name, family, source_type, derivative, denial, speculation) AS number FROM items)
SELECT story, coalesce(sum(number) FILTER (source_type = 'OFFICIAL' AND NOT derivative), 0)::BIGINT AS confirmed, coalesce(sum(number) FILTER (denial), 0)::BIGINT AS disputed,
 count(*) FILTER (NOT (source_type = 'OFFICIAL' AND NOT derivative) AND speculation >= 0.34) AS claims FROM n GROUP BY story"""
)
def agg_knowledge(spark, sf_dir):
    """AGG-24, as sums of the sources' numbers."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return cards.knowledge(items(spark, sf_dir)).select("story", total("confirmed_by").alias("confirmed"), total("disputed_by").alias("disputed"), F.size("claimed_by").cast("long").alias("claims"))


