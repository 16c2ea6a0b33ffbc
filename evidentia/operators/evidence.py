"""How well a story is sourced (AGG-1..10, 12, 14, 21): conditional aggregates per story.

Input rows are items of a story: story, kind ("news" or "social"), at, family (publisher family or
account), name, source_type, weight, derivative, official_words, denial, speculation, category,
engagement.  Items are shuffled by their story and folded in order; nothing is collected per story but
short lists of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.text import normalize
from ..functions.timefn import age_hours
from ..lexicons import BREAKING_CATEGORIES, CATEGORY_POINTS
from .classify import CREDIBLE, FIRST_PERSON, LOW, plain

CONFIG = EngineConfig()


def build_evidence(items: DataFrame) -> DataFrame:
    """AGG-1: one row per story, kind, family and copy or original, typed by its earliest item."""
    rows = items.repartition("story").groupBy(*SOURCE).agg(_first_item().alias("f"), F.count(F.lit(1)).alias("items"))
    return rows.select("story", "kind", "family", "derivative", "items", "f.source_type", "f.weight", "f.name")


#: What makes a row of evidence, in the order in which it is sorted: rows of a family and of a story then lie together.
SOURCE = ["story", "family", "kind", "derivative"]


def _first_item() -> Column:
    return F.min_by(F.struct("source_type", "weight", "name"), F.struct("at", "name", "source_type"))


def _is_news() -> Column:
    return F.col("kind") == "news"


def _counts(credible: Column) -> dict[str, Column]:
    """AGG-2 over rows of evidence, but for what a family of several rows counts once for."""
    news, told = _is_news(), F.col("family").isNotNull()
    return {
        "independent_count": F.count_if(news & credible & ~F.col("derivative") & told),
        "social_count": F.sum(F.when(~news, F.col("items"))),
        "copied_families": F.count_if(news & F.col("derivative")),
        "better_sources": F.count_if(~F.col("source_type").isin(LOW)),
        "evidence_rows": F.count(F.lit(1)),
        "is_source": F.max(F.when(news & told, 1)),
        "is_account": F.max(F.when(~news & credible & told, 1)),
    }


def _counted() -> list[Column]:
    """AGG-2 over the rows of families."""
    return [
        F.count("is_source").alias("source_count"),
        F.sum("independent_count").alias("independent_count"),
        F.coalesce(F.sum("social_count"), F.lit(0)).alias("social_count"),
        F.count("is_account").alias("credible_accounts"),
        *(F.sum(c).alias(c) for c in ("copied_families", "better_sources", "evidence_rows")),
    ]


def source_counts(evidence: DataFrame) -> DataFrame:
    """AGG-2: copies are never independent, a family counts once, posts are no news sources."""
    counts = _counts(F.col("source_type").isin(CREDIBLE))
    families = evidence.repartition("story").groupBy("story", "family").agg(*(c.alias(name) for name, c in counts.items()))
    return families.groupBy("story").agg(*_counted())


def item_facts(items: DataFrame, as_of: Column, config: EngineConfig = CONFIG, told: DataFrame | None = None) -> DataFrame:
    """AGG-3, 4, 5, 7, 10 and what AGG-9 and 12 need; with AGG-2's counts where `told` is given (see _told).

    What is counted by item is summed in one aggregate of numbers; what is distinct or first comes from the rows of
    evidence.  Distinct counts beside the others would multiply the items, and partial aggregates of
    so many columns are wider than the items, so these are shuffled as they are."""
    news, credible = _is_news(), F.col("source_type").isin(CREDIBLE)
    age = age_hours(F.col("at"), as_of)
    recent = age <= config.trending_hours
    measured = F.col("engagement").isNotNull()
    facts = items.repartition("story").groupBy("story").agg(
        F.round(F.coalesce(F.avg(F.when(news, F.col("speculation"))), F.lit(0.0)), 3).alias("speculation"),
        F.count_if(news & F.col("derivative")).alias("copies"),
        F.count_if((F.col("source_type") == "OFFICIAL") & ~F.col("derivative")).alias("official_items"),
        F.count_if(~news & (F.col("source_type") == "OFFICIAL")).alias("official_posts"),
        F.count_if(~news & credible).alias("credible_posts"),
        F.count_if(news & credible).alias("credible_articles"),
        F.count_if(F.col("denial")).alias("denials"),
        F.count_if(F.col("denial") & credible).alias("credible_denials"),
        F.count_if(news & ~F.col("denial") & credible).alias("credible_assertions"),
        F.count_if(news & ~F.col("denial") & F.col("official_words")).alias("confirmations"),
        F.count_if(news).alias("articles"),
        F.count_if(age <= config.verify_window_hours).alias("recent_items"),
        F.count_if(age <= config.developing_hours).alias("developing_items"),
        F.max("weight").alias("best_weight"),
        F.min("at").alias("first_seen"),
        F.max("at").alias("last_seen"),
        F.count_if(recent & news).alias("recent_articles"),
        F.count_if(recent & news & (F.col("source_type") == "OFFICIAL")).alias("recent_official"),
        F.count_if(recent & ~news).alias("recent_posts"),
        F.count_if(recent & ~news & credible).alias("recent_press_posts"),
        F.coalesce(F.sum(F.when(recent & ~news & measured, F.col("engagement"))), F.lit(0)).alias("recent_engagement"),
        F.count_if(~news).alias("posts"),
    )
    known = _told(items, as_of, config).select("story", "recent_families", "origin_type") if told is None else told
    return facts.join(known, "story")


def _told(items: DataFrame, as_of: Column, config: EngineConfig = CONFIG) -> DataFrame:
    """(story, AGG-2's counts, recent_families, origin_type), folded from rows of evidence to families to stories, which
    one sort of the items puts in order."""
    recent = age_hours(F.col("at"), as_of) <= config.trending_hours
    first = F.min(F.struct("at", "name", "source_type"))
    rows = items.repartition("story").groupBy(*SOURCE).agg(first.alias("first"), F.max(F.when(recent, 1)).alias("recent"), F.count(F.lit(1)).alias("items"))
    rows = rows.withColumn("source_type", F.col("first.source_type"))
    lately = F.col("recent").isNotNull() & _is_news() & ~F.col("derivative") & F.col("family").isNotNull()
    counts = _counts(F.col("source_type").isin(CREDIBLE)) | {"recent_families": F.count_if(lately), "first": F.min("first")}
    families = rows.groupBy("story", "family").agg(*(c.alias(name) for name, c in counts.items()))
    found = families.groupBy("story").agg(*_counted(), F.sum("recent_families").alias("recent_families"), F.min("first").alias("first"))
    return found.withColumn("origin_type", F.col("first.source_type")).drop("first")


def conflict_notes(items: DataFrame, most: int = 3) -> DataFrame:
    """AGG-4: (story, notes) of stories with denials: who denies, who asserts and who confirms in official words.

    items: story, name, source_type, kind, denial, official_words.  Names are ranked within their story and
    side, and a window stops at `most` before its rows are shuffled again."""
    credible, news = F.col("source_type").isin(CREDIBLE), F.col("kind") == "news"
    side = F.array(
        F.when(F.col("denial"), F.lit("denies")),
        F.when(~F.col("denial") & credible & news, F.lit("asserts")),
        F.when(~F.col("denial") & F.col("official_words") & news, F.lit("confirms")),
    )
    denied = items.filter("denial").select("story").distinct()
    rows = items.join(denied, "story", "left_semi").select("story", F.explode(F.array_compact(side)).alias("side"), "name").distinct()
    place = F.row_number().over(Window.partitionBy("story", "side").orderBy("name"))
    first = rows.withColumn("place", place).filter(F.col("place") <= most)
    named = first.groupBy("story").pivot("side", ["denies", "confirms", "asserts"]).agg(F.array_join(F.array_sort(F.collect_list("name")), ", "))
    told_of = {"denies": "denied by ", "confirms": "confirmed in official words by ", "asserts": "reported by "}
    notes = F.array(*(F.concat(F.lit(words), F.nullif(F.col(side), F.lit(""))) for side, words in told_of.items()))
    return named.select("story", F.array_compact(notes).alias("notes"))


def with_conflicts(facts: DataFrame, config: EngineConfig = CONFIG) -> DataFrame:
    """AGG-4 and 5: contradictions are kept, and what still moves."""
    conflict = F.col("denials") > 0
    official = F.col("official_items") > 0
    moving = (F.col("recent_items") >= config.verify_min_updates) | (conflict & (F.col("recent_items") >= 2))
    return facts.withColumns(
        {
            "official_confirmed": official,
            "has_conflict": conflict,
            "credible_disagreement": (F.col("credible_denials") > 0) & (F.col("credible_assertions") > 0),
            "is_moving": F.when(official & ~conflict, F.lit(False)).otherwise(moving),
        }
    )


def decide_status(category: Column) -> Column:
    """AGG-6: the first rule that holds."""
    voices = F.col("independent_count") + F.col("credible_accounts")
    official, conflict, hedged = F.col("official_confirmed"), F.col("has_conflict"), F.col("speculation") >= 0.34
    return (
        F.when(official & ~conflict, F.lit("CONFIRMED"))
        .when(conflict & F.col("credible_disagreement"), "CONTESTED")
        .when(official & conflict, "DEVELOPING")
        .when(conflict & (voices >= 1), "DEVELOPING")
        .when(F.col("is_moving") & (voices >= 1) & ~official & hedged, "DEVELOPING")
        .when(voices >= 2, "REPORTED")
        .when((voices == 1) & ((F.col("speculation") >= 0.67) | (category == "rumor")), "RUMOR")
        .when(voices == 1, "REPORTED")
        .when(F.col("origin_type").isin(FIRST_PERSON), "FIGHTER_CLAIM")
        .when((F.col("better_sources") == 0) & (F.col("evidence_rows") > 0), F.when(F.col("speculation") > 0, F.lit("RUMOR")).otherwise("UNVERIFIED"))
        .when(hedged, "RUMOR")
        .otherwise("UNVERIFIED")
    )


def support_score() -> Column:
    """AGG-9: 0 to 100, from parts that can be told."""
    independent = F.col("independent_count")
    total = (
        F.when(F.col("official_confirmed"), 55).otherwise(0)
        + F.when(independent >= 3, 30).when(independent == 2, 22).when(independent == 1, 12).otherwise(0)
        + F.round(F.col("best_weight") * 12, 1)
        + F.when((F.col("official_posts") > 0) & ~F.col("official_confirmed"), 10).otherwise(0)
        + F.when(F.col("credible_posts") > 0, 5).otherwise(0)
        - F.least(F.lit(12.0), F.col("copies") * 4.0)
        - F.round(F.col("speculation") * 15, 1)
        - F.when(F.col("has_conflict"), 15).otherwise(0)
    )
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)), 1)


def support_label(score: Column) -> Column:
    band = F.when(score >= 85, F.lit("STRONG SOURCE SUPPORT")).when(score >= 65, "GOOD SOURCE SUPPORT").when(score >= 45, "MODERATE SOURCE SUPPORT").when(score >= 25, "LIMITED SOURCE SUPPORT").otherwise("MINIMAL SOURCE SUPPORT")
    return F.when(F.col("has_conflict"), F.lit("CONTESTED - SOURCES DISAGREE")).otherwise(band)


def support_reasons() -> Column:
    """AGG-9, I11: every score carries its reasons, each with the points that it brought or cost."""
    n, shown = F.col("independent_count"), lambda x: x.cast("string")
    best, hedge = F.round(F.col("best_weight") * 12, 1), F.round(F.col("speculation") * 15, 1)
    copies = F.least(F.lit(12), F.col("copies") * 4).cast("int")
    return F.array_compact(
        F.array(
            F.when(F.col("official_confirmed"), F.lit("+55 official source")),
            F.when(n >= 3, F.concat(F.lit("+30 "), shown(n), F.lit(" independent sources"))).when(n == 2, F.lit("+22 two independent sources")).when(n == 1, F.lit("+12 one credible source")).otherwise(F.lit("+0 no independent source")),
            F.when(best > 0, F.concat(F.lit("+"), shown(best), F.lit(" reliability of the best source"))),
            F.when((F.col("official_posts") > 0) & ~F.col("official_confirmed"), F.lit("+10 official account")),
            F.when(F.col("credible_posts") > 0, F.lit("+5 posts of credible accounts")),
            F.when(copies > 0, F.concat(F.lit("-"), shown(copies), F.lit(" copies of other outlets"))),
            F.when(hedge > 0, F.concat(F.lit("-"), shown(hedge), F.lit(" hedged wording"))),
            F.when(F.col("has_conflict"), F.lit("-15 sources contradict each other")),
        )
    )


def trend_score() -> Column:
    """AGG-10, over the recent items."""
    posts, engagement = F.col("recent_posts"), F.col("recent_engagement")
    return (
        F.when(F.col("recent_families") >= 3, 6.0).when(F.col("recent_families") == 2, 3.0).otherwise(0.0)
        + F.when(F.col("recent_articles") >= 4, 4.0).otherwise(0.0)
        + F.when(F.col("recent_official") > 0, 3.0).otherwise(0.0)
        + F.least(F.lit(4.0), posts.cast("double"))
        + F.when(F.col("recent_press_posts") > 0, 2.0).otherwise(0.0)
        + F.when(engagement >= 50000, 4.0).when(engagement >= 5000, 2.0).otherwise(0.0)
        + F.when(F.col("updates") >= 4, 2.0).otherwise(0.0)
    )


def relevance_parts(category: Column, as_of: Column) -> dict[str, Column]:
    """AGG-12 as named parts; title, main_event, major and watch_hits are columns of the caller's."""
    age = age_hours(F.col("last_seen"), as_of)
    point = F.coalesce(*(F.when(category == k, F.lit(float(v))) for k, v in CATEGORY_POINTS.items()), F.lit(5.0))
    capped = lambda most, value: F.least(F.lit(float(most)), value.cast("double"))
    return {
        "development": point,
        "title": F.when(F.col("title_story"), 14.0).otherwise(0.0),
        "main_event": F.when(F.col("main_event"), 8.0).otherwise(0.0),
        "major": capped(14, F.col("major_hits") * 7),
        "independent": capped(16, F.col("independent_count") * 6),
        "quality": capped(8, F.col("credible_articles") * 2),
        "official": F.when(F.col("official_confirmed"), 8.0).otherwise(0.0),
        "social": capped(10, F.col("posts") * 2 + F.col("credible_posts") * 2),
        "moving": F.when(F.col("updates") >= 2, capped(10, F.col("updates") * 2)).otherwise(0.0),
        "trending": F.when(F.col("is_trending"), 6.0).otherwise(0.0),
        "freshness": F.when(age <= 3, 12.0).when(age <= 12, 8.0).when(age <= 36, 4.0).when(age > 96, -6.0).otherwise(0.0),
        "watchlist": capped(18, F.col("watch_hits") * 9),
        "low_information": F.when(category.isin("promo", "interview"), -8.0).otherwise(0.0),
        "hedged": F.when(F.col("speculation") >= 0.67, -4.0).otherwise(0.0),
    }


def told(parts: dict[str, Column]) -> Column:
    """AGG-12: the parts that count for something, by name."""
    every = F.create_map(*(x for name, value in parts.items() for x in (F.lit(name), value)))
    return F.map_filter(every, lambda _, v: v != 0)


def with_context(stories: DataFrame, context: DataFrame, watchlist: list[str], majors: list[str], title_terms: list[str], main_terms: list[str]) -> DataFrame:
    """AGG-12's inputs from a story's words: context (story, headline, summary, keywords, entities).

    title_story and main_event: the terms in headline, summary or keywords; major_hits: entities among the major
    ones; watch_hits: watch-list terms in these words or among the entities."""
    words = normalize(F.concat_ws(" ", "headline", "summary", F.concat_ws(" ", "keywords")))
    names = F.transform(F.coalesce("entities", F.array().cast("array<string>")), normalize)
    listed = lambda terms: F.array(*(F.lit(t) for t in terms)) if terms else F.array().cast("array<string>")
    found = context.select("story", words.alias("words"), names.alias("names"))
    within = lambda terms: F.exists(listed(terms), lambda t: F.col("words").contains(t))
    hits = F.filter(listed([plain(t) for t in watchlist if plain(t)]), lambda t: F.col("words").contains(t) | F.array_join("names", " ").contains(t))
    told_of = found.select(
        "story",
        within(title_terms).alias("title_story"),
        within(main_terms).alias("main_event"),
        F.size(F.filter("names", lambda n: F.array_contains(listed([plain(m) for m in majors]), n))).alias("major_hits"),
        F.size(hits).alias("watch_hits"),
    )
    rows = stories.join(told_of, "story", "left")
    return rows.na.fill({"title_story": False, "main_event": False, "major_hits": 0, "watch_hits": 0})


def relevance_band(score: Column) -> Column:
    return F.when(score >= 70, F.lit("HIGH")).when(score >= 55, "ELEVATED").when(score >= 35, "MEDIUM").otherwise("LOW")


def dominant_category(items: DataFrame) -> DataFrame:
    """AGG-14: official items weigh double; the general label loses ties, then the first seen wins."""
    weight = F.when(F.col("source_type") == "OFFICIAL", 2).otherwise(1)
    votes = items.filter("kind = 'news'").repartition("story").groupBy("story", "category").agg(F.sum(weight).alias("votes"), F.min("at").alias("first"))
    best = F.min(F.struct((-F.col("votes")).alias("v"), (F.col("category") == "general").alias("g"), "first", "category"))
    return votes.groupBy("story").agg(best.alias("b")).select("story", F.col("b.category").alias("category"))


def first_summary(items: DataFrame) -> DataFrame:
    """(story, summary): the first article's excerpt that isn't empty, for stories that have none of their own."""
    said = F.when((F.col("kind") == "news") & (F.trim("excerpt") != ""), F.struct("at", "name", "excerpt"))
    return items.groupBy("story").agg(F.min(said)["excerpt"].alias("summary"))


def rebuild_stories(items: DataFrame, as_of: Column, config: EngineConfig = CONFIG, context: DataFrame | None = None, terms: dict[str, list[str]] | None = None) -> DataFrame:
    """AGG-23: everything about a story from its items.  Aggregates and joins on the story's key alone.

    context and terms (see with_context) add what a story's words are worth; without them these parts are 0.
    Items with an excerpt give stories a summary."""
    facts = with_conflicts(item_facts(items, as_of, config, _told(items, as_of, config)), config)
    rows = facts.join(dominant_category(items), "story", "left")
    if "excerpt" in items.columns:
        rows = rows.join(first_summary(items), "story", "left")
    rows = rows.withColumn("category", F.coalesce("category", F.lit("general"))).withColumn("updates", F.col("articles") - 1)
    rows = rows.withColumns({"status": decide_status(F.col("category")), "support_score": support_score(), "trend_score": trend_score()})
    rows = rows.withColumns({"support_label": support_label(F.col("support_score")), "is_trending": F.col("trend_score") >= config.trending_threshold})
    if context is not None:
        rows = with_context(rows, context, **(terms or {}))
    missing = {c: F.lit(v) for c, v in (("title_story", False), ("main_event", False), ("major_hits", 0), ("watch_hits", 0)) if c not in rows.columns}
    rows = rows.withColumns(missing) if missing else rows
    parts = relevance_parts(F.col("category"), as_of)
    total = sum(parts.values(), F.lit(0.0))
    rows = rows.withColumns({"relevance": F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)), "breakdown": told(parts)})
    fresh = (age_hours(F.col("first_seen"), as_of) <= config.breaking_hours) & (F.col("relevance") >= config.breaking_relevance)
    # AGG-22 over the items, which are what a timeline holds of them
    burst = (F.col("developing_items") >= config.verify_min_updates) | (F.col("has_conflict") & (F.col("developing_items") >= 2))
    settled = F.col("official_confirmed") & ~F.col("has_conflict")
    flags = {
        "band": relevance_band(F.col("relevance")),
        "is_breaking": fresh & F.col("category").isin(BREAKING_CATEGORIES) & F.col("status").isin("CONFIRMED", "REPORTED", "DEVELOPING"),
        "is_developing": ~settled & (F.col("is_moving") | burst),
    }
    return rows.withColumns(flags)


def source_names(evidence: DataFrame, most: int = 5) -> DataFrame:
    """(story, group, names): the first names of each group of a story's sources.  Ranks stop at `most`
    before they are shuffled, so a story with many sources costs no more."""
    credible, news = F.col("source_type").isin(CREDIBLE), F.col("kind") == "news"
    groups = F.array(
        F.when((F.col("source_type") == "OFFICIAL") & ~F.col("derivative"), F.lit("official")),
        F.when(~news & (F.col("source_type") == "OFFICIAL"), F.lit("official_accounts")),
        F.when(news & credible & ~F.col("derivative"), F.lit("credible")),
        F.when(F.col("source_type").isin(LOW), F.lit("low")),
        F.when(F.col("source_type").isin(FIRST_PERSON), F.lit("first_person")),
    )
    rows = evidence.select("story", F.explode(F.array_compact(groups)).alias("group"), "name").distinct()
    place = F.row_number().over(Window.partitionBy("story", "group").orderBy("name"))
    first = rows.withColumn("place", place).filter(F.col("place") <= most)
    return first.groupBy("story", "group").agg(F.array_sort(F.collect_list("name")).alias("names"))  # at most `most`


def status_reasons(stories: DataFrame, evidence: DataFrame) -> DataFrame:
    """AGG-8: (story, reasons, is_rumor): why a story has its status, in a fixed order."""
    names = source_names(evidence).groupBy("story").pivot("group", ["official", "official_accounts", "credible", "low", "first_person"]).agg(F.first("names"))
    rows = stories.join(names, "story", "left")
    said = lambda c, most: F.array_join(F.slice(c, 1, most), ", ")
    whole = lambda c: F.col(c).cast("string")
    reasons = F.array(
        F.when(F.col("official_confirmed"), F.concat(F.lit("official: "), said("official", 3))),
        F.when(F.col("official_accounts").isNotNull(), F.concat(F.lit("official accounts: "), said("official_accounts", 3))),
        F.when(F.col("independent_count") > 0, F.concat(whole("independent_count"), F.lit(" independent of "), whole("source_count"), F.lit(" sources: "), said("credible", 5))),
        F.when(F.col("social_count") > 0, F.concat(whole("social_count"), F.lit(" posts, which count as no source"))),
        F.when(F.col("copied_families") > 0, F.concat(whole("copied_families"), F.lit(" copies of other outlets"))),
        F.when(F.col("low").isNotNull() & (F.col("independent_count") == 0), F.concat(F.lit("only low reliability: "), said("low", 4))),
        F.when(F.col("first_person").isNotNull(), F.concat(F.lit("first-person claim: "), said("first_person", 3))),
        F.when(F.col("speculation") >= 0.34, F.lit("hedged wording")),
        F.when(F.col("has_conflict"), F.lit("sources disagree")),
    )
    return rows.select("story", F.array_compact(reasons).alias("reasons"), F.col("status").isin("RUMOR", "UNVERIFIED", "FIGHTER_CLAIM").alias("is_rumor"))


def developing(timeline: DataFrame, conflicts: DataFrame, as_of: Column, hours: int = CONFIG.developing_hours) -> DataFrame:
    """AGG-22: stories (story, has_conflict) with three recent entries of their timeline (story, kind, at), or two and a conflict."""
    counts = F.col("kind").isin("article", "social", "card_change", "status_change") & (age_hours(F.col("at"), as_of) <= hours)
    recent = timeline.groupBy("story").agg(F.count_if(counts).alias("recent"))
    rows = conflicts.join(recent, "story", "left").withColumn("recent", F.coalesce("recent", F.lit(0)))
    return rows.withColumn("is_developing", (F.col("recent") >= 3) | (F.col("has_conflict") & (F.col("recent") >= 2)))
