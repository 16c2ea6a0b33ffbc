"""Data-quality checks (DQ-*): each gives rows (level, check, row_key, detail), all in one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.timefn import age_hours, is_future, is_plausible
from ..functions.url import is_malformed
from .matching import same_headlines


def finding(rows: DataFrame, level: str, check: str, key: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(level).alias("level"), F.lit(check).alias("check"), key.cast("string").alias("row_key"), detail.cast("string").alias("detail"))


def duplicates(rows: DataFrame, key: Column, level: str, check: str) -> DataFrame:
    """DQ-1, 2, 6, 9"""
    groups = rows.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & F.col("k").isNotNull())
    return finding(groups, level, check, F.col("k"), F.col("n"))


def failing(rows: DataFrame, bad: Column, level: str, check: str, key: Column, detail: Column) -> DataFrame:
    """DQ-3, 4, 7, 11, 12, 13: rows that a predicate condemns."""
    return finding(rows.filter(F.coalesce(bad, F.lit(False))), level, check, key, detail)


def orphans(rows: DataFrame, parents: DataFrame, on: str, level: str, check: str) -> DataFrame:
    """DQ-5, 17, JOIN-5: rows without a parent."""
    return finding(rows.join(parents.select(on).distinct(), on, "left_anti"), level, check, F.col(on), F.lit("no parent"))


def bad_dates(rows: DataFrame, at: str, key: str, as_of: Column) -> DataFrame:
    """DQ-8"""
    bad = rows.filter(F.col(at).isNotNull() & ~is_plausible(F.col(at), as_of))
    return finding(bad, "WARN", "implausible_date", F.col(key), F.when(is_future(F.col(at), as_of), F.lit("future")).otherwise(F.lit("too early")))


def bad_urls(rows: DataFrame, url: str, key: str) -> DataFrame:
    """DQ-14"""
    return failing(rows, is_malformed(F.col(url)), "ERROR", "malformed_url", F.col(key), F.col(url))


def breaking_too_old(stories: DataFrame, as_of: Column, hours: int = 48) -> DataFrame:
    """DQ-7"""
    return failing(stories, F.col("is_breaking") & (age_hours(F.col("last_seen"), as_of) > hours), "WARN", "stale_breaking", F.col("story"), F.col("last_seen"))


def event_status(events: DataFrame, as_of: Column) -> DataFrame:
    """DQ-3: over before the start (ERROR); still upcoming two days after it, or under way without one (WARN)."""
    start, key, status = F.coalesce("start", F.col("event_date").cast("timestamp")), F.col("event"), F.col("status")
    early = failing(events, (status == "COMPLETED") & (start > as_of), "ERROR", "completed_before_start", key, start)
    late = failing(events, (status == "UPCOMING") & (age_hours(F.col("start"), as_of) >= 72), "WARN", "stale_upcoming", key, F.col("start"))
    bare = failing(events, status.isin("LIVE", "COMPLETED") & F.col("start").isNull(), "WARN", "status_without_schedule", key, status)
    return run_all([early, late, bare])


def results_from_predictions(articles: DataFrame) -> DataFrame:
    """DQ-4"""
    return failing(articles, F.col("intent").isin("PREVIEW", "PREDICTION") & (F.col("category") == "result"), "ERROR", "prediction_as_result", F.col("id"), F.col("intent"))


def near_headlines(stories: DataFrame, prefix: int = 90) -> DataFrame:
    """DQ-6"""
    groups = same_headlines(stories, prefix)
    return finding(groups, "WARN", "same_headline", F.col("key"), F.col("stories"))


def rankings(current: DataFrame) -> DataFrame:
    """DQ-9: of current rows (division, name, position, is_champion): two champions, two in one place."""
    crowns = current.filter("is_champion").groupBy("division").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    places = current.filter("position > 0").groupBy("division", "position").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return run_all([finding(crowns, "ERROR", "multiple_champions", F.col("division"), F.col("n")), finding(places, "ERROR", "duplicate_position", F.concat_ws("|", "division", "position"), F.col("n"))])


def conflicts(events: DataFrame) -> DataFrame:
    """DQ-10: every note (event, conflicts) of reporting that disagrees with the official schedule."""
    return finding(events.select("event", F.explode("conflicts").alias("note")), "WARN", "official_conflict", F.col("event"), F.col("note"))


def source_counts(stories: DataFrame) -> DataFrame:
    """DQ-11: more independent sources than sources (ERROR), articles without a source (WARN)."""
    over = failing(stories, F.col("independent_count") > F.col("source_count"), "ERROR", "independent_over_total", F.col("story"), F.col("independent_count"))
    none = failing(stories, (F.col("articles") > 0) & (F.col("source_count") == 0), "WARN", "articles_without_sources", F.col("story"), F.col("articles"))
    return run_all([over, none])


def bout_contradictions(bouts: DataFrame) -> DataFrame:
    """DQ-12: official exactly if the evidence is the official card."""
    bad = (F.col("official_status") == "official") != (F.col("evidence_level") == "official_card")
    return failing(bouts, bad, "ERROR", "bout_contradiction", F.concat_ws("|", "event", "pair_key"), F.concat_ws(" / ", "official_status", "evidence_level"))


def unclassified(articles: DataFrame) -> DataFrame:
    """DQ-13"""
    return failing(articles, F.col("intent").isNull() | (F.col("intent") == ""), "WARN", "unclassified_intent", F.col("id"), F.lit("no intent"))


def schema_drift(df: DataFrame, declared: StructType, name: str) -> DataFrame:
    """DQ-15: declared columns that are missing or of another type, and columns not declared."""
    have, want = dict(df.dtypes), {f.name: f.dataType.simpleString() for f in declared}
    rows = [("ERROR", "schema_drift", f"{name}.{c}", f"expected {t}, found {have.get(c, 'nothing')}") for c, t in want.items() if have.get(c) != t]
    rows += [("WARN", "schema_drift", f"{name}.{c}", "not declared") for c in have if c not in want]
    return df.sparkSession.createDataFrame(rows, "level string, check string, row_key string, detail string")


def reconcile(parts: DataFrame, count: str, total: DataFrame, check: str) -> DataFrame:
    """DQ-16: states that are exhaustive and exclusive add up to the whole."""
    both = parts.agg(F.sum(count).alias("a")).join(F.broadcast(total.agg(F.count(F.lit(1)).alias("b"))))  # one row each
    return finding(both.filter("a <> b"), "ERROR", check, F.lit("total"), F.concat_ws(" of ", "a", "b"))


def run_all(checks: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), checks)
