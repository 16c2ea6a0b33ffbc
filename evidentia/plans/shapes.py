"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lexicons import BREAKING_CATEGORIES, PRIORITY
from ..operators.classify import WEIGHTS, reliability
from .registry import table

TYPES = list(WEIGHTS)
LABELS = [*PRIORITY, "general"]
AS_OF = "1999-06-01 06:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def pick(index, values: list[str]):
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of stories: line items of orders, by supplier and the supplier's nation."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    kind = pick(F.col("l_suppkey"), TYPES)
    return rows.select(
        F.col("l_orderkey").alias("story"),
        F.when(F.col("l_linenumber") % 4 == 3, F.lit("social")).otherwise(F.lit("news")).alias("kind"),
        F.col("l_shipdate").cast("timestamp").alias("at"),
        F.col("s_nationkey").cast("string").alias("family"),
        F.col("s_name").alias("name"),
        kind.alias("source_type"),
        reliability(kind).alias("weight"),
        (F.col("l_returnflag") == "R").alias("derivative"),
        (F.col("l_linestatus") == "O").alias("official_words"),
        (F.col("l_partkey") % 50 == 0).alias("denial"),
        (F.col("l_discount") * 10).alias("speculation"),
        pick(F.col("l_partkey"), LABELS).alias("category"),
        F.when(F.col("l_quantity") >= 5, (F.col("l_quantity") * 1000).cast("long")).alias("engagement"),
    )


def breaking_sql(hours: int = 8, relevance: int = 70) -> str:
    listed = ", ".join(repr(c) for c in BREAKING_CATEGORIES)
    return f"date_diff('second', first_seen, TIMESTAMP '{AS_OF}') / 3600.0 <= {hours} AND relevance >= {relevance} AND status IN ('CONFIRMED','REPORTED','DEVELOPING') AND category IN ({listed})"


BREAKING_SQL = breaking_sql()
_list = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
WEIGHT_SQL = "CASE source_type " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in WEIGHTS.items()) + " END"
ITEMS_SQL = f"""
items0 AS (SELECT l_orderkey AS story, CASE WHEN l_linenumber % 4 = 3 THEN 'social' ELSE 'news' END AS kind, l_shipdate AS t0,
  CAST(s_nationkey AS VARCHAR) AS family, s_name AS name, ({_list(TYPES)})[l_suppkey % {len(TYPES)} + 1] AS source_type, l_returnflag = 'R' AS derivative,
  l_linestatus = 'O' AS official_words, l_partkey % 50 = 0 AS denial, l_discount * 10 AS speculation, ({_list(LABELS)})[l_partkey % {len(LABELS)} + 1] AS category,
  CASE WHEN l_quantity >= 5 THEN CAST(l_quantity * 1000 AS BIGINT) END AS engagement
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
items AS (SELECT *, {WEIGHT_SQL} AS weight, date_diff('second', t0, TIMESTAMP '{AS_OF}') / 3600.0 AS age,
  source_type IN ('OFFICIAL','MAJOR_NEWS','ESTABLISHED_JOURNALIST','TRUSTED_REPORTER') AS credible FROM items0),
evidence AS (SELECT story, kind, family, derivative, count(*) AS items, first(source_type ORDER BY t0, name, source_type) AS source_type FROM items GROUP BY ALL),
counts AS (SELECT story, count(DISTINCT family) FILTER (kind = 'news') AS source_count,
  count(DISTINCT family) FILTER (kind = 'news' AND source_type IN ('OFFICIAL','MAJOR_NEWS','ESTABLISHED_JOURNALIST','TRUSTED_REPORTER') AND NOT derivative) AS independent_count,
  coalesce(sum(items) FILTER (kind <> 'news'), 0)::BIGINT AS social_count,
  count(DISTINCT family) FILTER (kind <> 'news' AND source_type IN ('OFFICIAL','MAJOR_NEWS','ESTABLISHED_JOURNALIST','TRUSTED_REPORTER')) AS credible_accounts,
  count(*) FILTER (kind = 'news' AND derivative) AS copied_families, count(*) FILTER (source_type NOT IN ('UNKNOWN','FAN_ACCOUNT')) AS better_sources, count(*) AS evidence_rows
  FROM evidence GROUP BY story),
facts AS (SELECT story, round(coalesce(avg(speculation) FILTER (kind = 'news'), 0.0), 3) AS speculation, count(*) FILTER (kind = 'news' AND derivative) AS copies,
  count(*) FILTER (source_type = 'OFFICIAL' AND NOT derivative) AS official_items, count(*) FILTER (kind <> 'news' AND source_type = 'OFFICIAL') AS official_posts,
  count(*) FILTER (kind <> 'news' AND credible) AS credible_posts, count(*) FILTER (kind = 'news' AND credible) AS credible_articles, count(*) FILTER (denial) AS denials,
  count(*) FILTER (denial AND credible) AS credible_denials, count(*) FILTER (kind = 'news' AND NOT denial AND credible) AS credible_assertions,
  count(*) FILTER (kind = 'news') AS articles, count(*) FILTER (age <= 12) AS recent_items, max(weight) AS best_weight, first(source_type ORDER BY t0, name, source_type) AS origin_type,
  min(t0) AS first_seen, max(t0) AS last_seen, count(DISTINCT family) FILTER (age <= 12 AND kind = 'news' AND NOT derivative) AS recent_families,
  count(*) FILTER (age <= 12 AND kind = 'news') AS recent_articles, count(*) FILTER (age <= 12 AND kind = 'news' AND source_type = 'OFFICIAL') AS recent_official,
  count(*) FILTER (age <= 12 AND kind <> 'news') AS recent_posts, count(*) FILTER (age <= 12 AND kind <> 'news' AND credible) AS recent_press,
  coalesce(sum(engagement) FILTER (age <= 12 AND kind <> 'news'), 0)::BIGINT AS recent_engagement, count(*) FILTER (kind <> 'news') AS posts
  FROM items GROUP BY story),
votes AS (SELECT story, category, sum(CASE WHEN source_type = 'OFFICIAL' THEN 2 ELSE 1 END) AS v, min(t0) AS f FROM items WHERE kind = 'news' GROUP BY ALL),
dominant AS (SELECT story, first(category ORDER BY v DESC, category = 'general', f, category) AS category FROM votes GROUP BY story),
joined AS (SELECT f.*, c.source_count, c.independent_count, c.social_count, c.credible_accounts, c.copied_families, c.better_sources, c.evidence_rows, coalesce(d.category, 'general') AS category, articles - 1 AS updates,
  official_items > 0 AS official_confirmed, denials > 0 AS has_conflict, credible_denials > 0 AND credible_assertions > 0 AS credible_disagreement,
  CASE WHEN official_items > 0 AND denials = 0 THEN false ELSE recent_items >= 3 OR (denials > 0 AND recent_items >= 2) END AS is_moving
  FROM facts f JOIN counts c USING (story) LEFT JOIN dominant d USING (story)),
scored AS (SELECT *, CASE WHEN official_confirmed AND NOT has_conflict THEN 'CONFIRMED' WHEN has_conflict AND credible_disagreement THEN 'CONTESTED'
  WHEN official_confirmed THEN 'DEVELOPING' WHEN has_conflict AND independent_count + credible_accounts >= 1 THEN 'DEVELOPING'
  WHEN is_moving AND independent_count + credible_accounts >= 1 AND speculation >= 0.34 THEN 'DEVELOPING' WHEN independent_count + credible_accounts >= 2 THEN 'REPORTED'
  WHEN independent_count + credible_accounts = 1 THEN CASE WHEN speculation >= 0.67 OR category = 'rumor' THEN 'RUMOR' ELSE 'REPORTED' END
  WHEN origin_type IN ('FIGHTER','COACH_TEAM','PROMOTER') THEN 'FIGHTER_CLAIM' WHEN better_sources = 0 THEN CASE WHEN speculation > 0 THEN 'RUMOR' ELSE 'UNVERIFIED' END
  WHEN speculation >= 0.34 THEN 'RUMOR' ELSE 'UNVERIFIED' END AS status,
  round(greatest(0.0, least(100.0, CASE WHEN official_confirmed THEN 55 ELSE 0 END + CASE WHEN independent_count >= 3 THEN 30 WHEN independent_count = 2 THEN 22 WHEN independent_count = 1 THEN 12 ELSE 0 END
   + round(best_weight * 12, 1) + CASE WHEN official_posts > 0 AND NOT official_confirmed THEN 10 ELSE 0 END + CASE WHEN credible_posts > 0 THEN 5 ELSE 0 END
   - least(12.0, copies * 4.0) - round(speculation * 15, 1) - CASE WHEN has_conflict THEN 15 ELSE 0 END)), 1)::DOUBLE AS support_score,
  (CASE WHEN recent_families >= 3 THEN 6 WHEN recent_families = 2 THEN 3 ELSE 0 END + CASE WHEN recent_articles >= 4 THEN 4 ELSE 0 END + CASE WHEN recent_official > 0 THEN 3 ELSE 0 END
   + least(4, recent_posts) + CASE WHEN recent_press > 0 THEN 2 ELSE 0 END + CASE WHEN recent_engagement >= 50000 THEN 4 WHEN recent_engagement >= 5000 THEN 2 ELSE 0 END
   + CASE WHEN updates >= 4 THEN 2 ELSE 0 END)::DOUBLE AS trend_score FROM joined),
pointed AS (SELECT *, trend_score >= 10 AS is_trending,
  (CASE category WHEN 'cancellation' THEN 30 WHEN 'replacement' THEN 28 WHEN 'injury' THEN 26 WHEN 'fight_announcement' THEN 25 WHEN 'retirement' THEN 24 WHEN 'suspension' THEN 22 WHEN 'title' THEN 22
   WHEN 'ranking' THEN 16 WHEN 'result' THEN 16 WHEN 'event_change' THEN 18 WHEN 'business' THEN 14 WHEN 'controversy' THEN 16 WHEN 'fighter_statement' THEN 8 WHEN 'interview' THEN 4 WHEN 'promo' THEN 1 WHEN 'general' THEN 6 WHEN 'rumor' THEN 10 ELSE 5 END
  + least(16, independent_count * 6) + least(8, credible_articles * 2) + CASE WHEN official_confirmed THEN 8 ELSE 0 END + least(10, posts * 2 + credible_posts * 2)
  + CASE WHEN updates >= 2 THEN least(10, updates * 2) ELSE 0 END + CASE WHEN trend_score >= 10 THEN 6 ELSE 0 END
  + CASE WHEN date_diff('second', last_seen, TIMESTAMP '{AS_OF}') / 3600.0 <= 3 THEN 12 WHEN date_diff('second', last_seen, TIMESTAMP '{AS_OF}') / 3600.0 <= 12 THEN 8
     WHEN date_diff('second', last_seen, TIMESTAMP '{AS_OF}') / 3600.0 <= 36 THEN 4 WHEN date_diff('second', last_seen, TIMESTAMP '{AS_OF}') / 3600.0 > 96 THEN -6 ELSE 0 END
  + CASE WHEN category IN ('promo','interview') THEN -8 ELSE 0 END + CASE WHEN speculation >= 0.67 THEN -4 ELSE 0 END)::DOUBLE AS points FROM scored),
stories AS (SELECT *, greatest(0.0, least(100.0, points))::DOUBLE AS relevance FROM pointed)
"""
