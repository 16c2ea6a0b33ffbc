"""Feeds, search, sections, health and counters (FLT-*, WIN-*, SNK-*, AGG-15..20, 25, SET-*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..config import EngineConfig
from ..functions.text import any_of, normalize
from ..functions.timefn import age_hours
from ..lexicons import TITLE_TERMS
from .matching import first_by

CONFIG = EngineConfig()

#: Names of the feeds and what they show.
NAMED: dict[str, str] = {
    "ALL": "true",
    "BREAKING": "is_breaking",
    "IMPORTANT": "relevance >= 55",
    "RUMORS": "status in ('RUMOR', 'UNVERIFIED', 'FIGHTER_CLAIM')",
    "DEVELOPING": "is_moving",
    "TRENDING": "is_trending",
    "FIGHT ANNOUNCEMENTS": "category = 'fight_announcement'",
    "INJURIES": "category = 'injury'",
    "RANKINGS": "category = 'ranking'",
    "TITLE": "category = 'title'",
    "RESULTS": "category = 'result'",
    "FIGHTERS": "category = 'fighter_statement'",
    "UFC BUSINESS": "category = 'business'",
    "CONTROVERSY": "category = 'controversy'",
}
SORTS: dict[str, list[str]] = {
    "Newest": ["first_seen"],
    "Most Relevant": ["relevance", "last_seen"],
    "Most Sources": ["source_count", "last_seen"],
    "Most Discussed": ["posts", "last_seen"],
    "Recently Updated": ["last_seen"],
}


def feed(stories: DataFrame, name: str = "ALL", sort: str | None = "Newest", since: Column | None = None, search: str | None = None, entity: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """FLT-1, 2, 4, WIN-4: conjunction of the optional predicates, top rows in a total order (in none without a sort)."""
    tests = [shows(stories, name)]
    if since is not None:
        tests.append(F.col("last_seen") >= since)
    if search:
        tests.append(reduce(lambda a, b: a | b, (F.col(c).ilike(f"%{search}%") for c in ("headline", "category") if c in stories.columns)))
    if entity:
        tests.append(F.array_contains("entities", entity))
    rows = stories.filter(reduce(lambda a, b: a & b, tests))
    if sort is not None:
        rows = rows.orderBy(*(F.col(c).desc_nulls_last() for c in SORTS[sort]), F.col("story"))
    rows = rows.offset(offset) if offset else rows
    return rows.limit(limit) if limit is not None else rows


def is_title_story(stories: DataFrame) -> Column:
    """FLT-3: a story of the category, or one that names a title in headline, summary or keywords."""
    texts = [F.col(c) for c in ("headline", "summary") if c in stories.columns] + [F.array_join(c, " ") for c in ("keywords",) if c in stories.columns]
    return (F.col("category") == "title") | any_of(normalize(F.concat_ws(" ", *texts)), TITLE_TERMS) if texts else F.col("category") == "title"


def shows(stories: DataFrame, name: str) -> Column:
    """FLT-2: whether a named feed shows a story."""
    return F.coalesce(is_title_story(stories) if name == "TITLE" else F.expr(NAMED[name]), F.lit(False))


def list_events(events: DataFrame, statuses: list[str] | None = None, upcoming: bool = False, limit: int | None = None) -> DataFrame:
    """FLT-6: events (event, status, start, event_date, merged_into) by lifecycle status, never by the calendar;
    merged ones are not listed, undated ones come last."""
    rows = events.filter("merged_into is null")
    wanted = statuses or (["UPCOMING", "LIVE", "POSTPONED", "UNKNOWN"] if upcoming else None)
    rows = rows.filter(F.col("status").isin(wanted)) if wanted else rows
    when = F.coalesce("start", F.col("event_date").cast("timestamp"))
    rows = rows.orderBy(when.asc_nulls_last() if wanted else when.desc_nulls_last(), "event")
    return rows.limit(limit) if limit is not None else rows


def lookup(rows: DataFrame, by: str, value, order: list[Column] = ()) -> DataFrame:
    """FLT-7: rows whose column is the value, or whose list holds it (exactly, not as a part of a name)."""
    listed = isinstance(rows.schema[by].dataType, ArrayType)
    found = rows.filter(F.array_contains(by, value) if listed else F.col(by) == value)
    return found.orderBy(*order) if order else found


def candidate_urls(last_good: Column, primary: Column, fallbacks: Column) -> Column:
    """FLT-8: addresses of a feed to try, each once: what worked last, the usual one, the others."""
    return F.array_distinct(F.filter(F.concat(F.array(last_good, primary), F.coalesce(fallbacks, F.array().cast("array<string>"))), lambda u: u.isNotNull() & (u != "")))


def sections(stories: DataFrame, cap: int) -> DataFrame:
    """WIN-6: each story once, in the first section that takes it, ranked there; the cap comes last."""
    section = (
        F.when(F.col("is_breaking"), F.lit("1 breaking"))
        .when(F.col("relevance") >= CONFIG.important_relevance, "2 important")
        .when(F.col("status").isin("RUMOR", "UNVERIFIED", "FIGHTER_CLAIM"), "3 rumors")
        .when(F.col("is_moving"), "4 developing")
        .when(F.col("is_trending"), "5 trending")
        .otherwise("6 latest")
    )
    order = Window.partitionBy("section").orderBy(F.col("relevance").desc(), F.col("last_seen").desc(), "story")
    return stories.withColumn("section", section).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= cap)


def search(kinds: dict[str, tuple[DataFrame, str, str]], term: str) -> DataFrame:
    """FLT-5: (kind, id, label) of everything that contains the term, whatever its case."""
    parts = [df.filter(F.col(text).ilike(f"%{term}%")).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col(text).alias("label")) for kind, (df, key, text) in kinds.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def upsert_posts(old: DataFrame, new: DataFrame, key: list[str], metrics: list[str], at: str) -> DataFrame:
    """SNK-2: immutable columns from a post's first row, metrics from its latest that has them."""
    rows = old.unionByName(new, allowMissingColumns=True)
    fixed = [c for c in rows.columns if c not in {*key, *metrics}]
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col(at), F.col(c).cast("string")))).alias(c) for c in fixed if c != at]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col(at), F.col(c)))).alias(c) for c in metrics]
    return rows.groupBy(*key).agg(*first, *last, F.max(at).alias(at))


def append_timeline(log: DataFrame, new: DataFrame) -> DataFrame:
    """SNK-3: entries of new that the log doesn't hold, each once per story; of those alike the first by their other columns."""
    key = F.sha1(F.concat_ws("|", "kind", F.col("occurred_at").cast("string"), "headline", "url"))
    rows = first_by(new.withColumn("dedup_key", key), ["story", "dedup_key"], [F.col(c) for c in sorted(new.columns) if c != "story"])
    return rows.join(log.select("story", "dedup_key"), ["story", "dedup_key"], "left_anti")


def append_snapshot(store: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """SNK-4: rows with a name whose key is not stored; of those with one key the first by their other columns."""
    rest = [F.col(c) for c in sorted(new.columns) if c not in key] or [F.lit(1)]
    return first_by(new.filter(F.trim("name") != ""), key, rest).join(store.select(*key), key, "left_anti")


def merge_dimension(old: DataFrame, new: DataFrame, key: str, protected: list[str], overwrite: bool = False) -> DataFrame:
    """SNK-5: new values replace old ones but for protected columns."""
    o, n = old.alias("o"), new.alias("n")
    value = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c in protected and not overwrite else F.coalesce(f"n.{c}", f"o.{c}")
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *(value(c).alias(c) for c in old.columns if c != key))


def upsert_entities(old: DataFrame, new: DataFrame, key: str = "entity", lists: list[str] = ("aliases",)) -> DataFrame:
    """SNK-6: gaps are filled and nothing is replaced; lists are sorted unions."""
    o, n = old.alias("o"), new.alias("n")
    none = F.array().cast("array<string>")
    value = lambda c: F.array_sort(F.array_union(F.coalesce(f"o.{c}", none), F.coalesce(f"n.{c}", none))) if c in lists else F.coalesce(f"o.{c}", f"n.{c}")
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *(value(c).alias(c) for c in old.columns if c != key))


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """SNK-7: replaces the partitions that df has rows for, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def counters(stories: DataFrame, as_of: Column) -> DataFrame:
    """AGG-15: the header's counts in one pass."""
    return stories.agg(
        F.count(F.lit(1)).alias("stories"),
        F.count_if("is_breaking").alias("breaking"),
        F.count_if(F.col("relevance") >= CONFIG.important_relevance).alias("important"),
        F.count_if(F.col("status") == "CONFIRMED").alias("confirmed"),
        F.count_if(F.col("status") == "CONTESTED").alias("contested"),
        F.count_if(F.col("status").isin("RUMOR", "UNVERIFIED", "FIGHTER_CLAIM")).alias("rumors"),
        F.count_if("is_moving").alias("developing"),
        F.count_if("is_trending").alias("trending"),
        F.count_if(age_hours(F.col("last_seen"), as_of) <= 24).alias("updated_today"),
    )


def source_health(attempts: DataFrame, as_of: Column, config: EngineConfig = CONFIG) -> DataFrame:
    """AGG-17, 18: attempts (source, at, ok, items, enabled) folded to one exclusive state per source (I8)."""
    last = attempts.groupBy("source").agg(
        F.max("at").alias("last_attempt"),
        F.max(F.when(F.col("ok"), F.col("at"))).alias("last_success"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("items"))), F.lit(0)).alias("items"),
        F.max_by("enabled", "at").alias("enabled"),
    )
    rows = attempts.join(last.select("source", "last_success"), "source")
    failures = rows.groupBy("source").agg(F.count_if(~F.col("ok") & (F.col("last_success").isNull() | (F.col("at") > F.col("last_success")))).alias("failures"))
    state = (
        F.when(~F.col("enabled"), F.lit("disabled"))
        .when(F.col("last_attempt").isNull(), "never_tried")
        .when(F.col("last_success").isNull(), "never_worked")
        .when(F.col("failures") >= 3, "failing")
        .when(F.col("failures") > 0, "unstable")
        .when(age_hours(F.col("last_success"), as_of) > config.stale_source_hours, "stale")
        .otherwise("working")
    )
    return last.join(failures, "source").withColumn("state", state)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """AGG-20: (name, rows) of every table."""
    return reduce(lambda a, b: a.unionByName(b), (df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in tables.items()))


def poll_state(attempts: DataFrame, account: str = "account", post_id: str = "post_id") -> DataFrame:
    """AGG-26: when an account was checked last, its newest post and its last error (attempts: at, error)."""
    newest = F.max(F.when(F.col(post_id).isNotNull(), F.struct(F.length(post_id), F.col(post_id).alias("id"))))["id"]
    return attempts.groupBy(account).agg(F.max("at").alias("last_checked"), newest.alias("last_post_id"), F.max_by("error", F.when(F.col("error").isNotNull(), F.struct("at", "error"))).alias("last_error"))


def engagement(items: DataFrame) -> DataFrame:
    """AGG-16: what a story's posts add up to; unmeasured ones count as nothing."""
    return items.filter("kind = 'social'").groupBy("story").agg(F.coalesce(F.sum("engagement"), F.lit(0)).alias("engagement"), F.count(F.lit(1)).alias("posts"))


def top_posts(posts: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """WIN-7: the most engaged posts; unmeasured ones don't count.  The cap is the report's."""
    return posts.filter(F.col(by).isNotNull()).orderBy(F.col(by).desc(), key).limit(most)


def latest(rows: DataFrame, at: Column, since: Column, key: str, most: int) -> DataFrame:
    """FLT-4: the newest rows since a time.  The cap is the feed's."""
    return rows.filter(at >= since).orderBy(at.desc(), key).limit(most)


def unseen(rows: DataFrame, shown: DataFrame, key: str) -> DataFrame:
    """SET-3, JOIN-5: keys of rows that aren't shown yet."""
    return rows.select(key).distinct().join(shown.select(key), key, "left_anti")


def ranking_systems(snapshots: DataFrame, system: str, at: str) -> DataFrame:
    """AGG-13"""
    return snapshots.groupBy(system).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first_date"), F.max(at).alias("last_date"))


def bursts(items: DataFrame, key: str, at: str, family: str, hours: int = CONFIG.verify_window_hours, least: int = CONFIG.verify_min_updates) -> DataFrame:
    """STRM-4 in batch: windows of time in which a key has so many items."""
    rows = items.groupBy(F.window(at, f"{hours} hours").alias("w"), key).agg(F.count(F.lit(1)).alias("items"), F.count_distinct(family).alias("families"))
    return rows.filter(F.col("items") >= least)


def outcomes(runs: DataFrame, run: Column, ok: Column) -> DataFrame:
    """AGG-19: (run, ok, failed, outcome) from an attempt log."""
    counts = runs.groupBy(run.alias("run")).agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"))
    return counts.withColumn("outcome", run_outcome(F.col("ok"), F.col("failed")))


def run_outcome(ok: Column, failed: Column) -> Column:
    """AGG-19: derived from the counts."""
    return F.when(ok + failed == 0, F.lit("NOT_RUN")).when(failed == 0, "SUCCESS").when(ok == 0, "TOTAL_FAILURE").otherwise("PARTIAL")
