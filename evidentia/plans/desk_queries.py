"""Queries over stories as a desk sees them: feeds, counters, reasons, listings, checks (2.4, 2.9, 2.11, 2.15)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import url
from ..lexicons import TITLE_TERMS
from ..operators import cards, checks, entities, evidence, feeds, rebuild
from ..sources.scratch import keep
from . import newsroom
from .news_queries import any_in
from .newsroom import ARTICLES, chosen
from .registry import query, table
from .shapes import AS_OF, BREAKING_SQL, ITEMS_SQL, as_of, breaking_sql, items, pick
from .text_queries import norm

DESK = f"{ITEMS_SQL}, {ARTICLES}, desk AS (SELECT s.*, title AS headline, {norm('title')} AS words, {BREAKING_SQL} AS is_breaking FROM stories s JOIN art ON art.id = story)"
RUMORS = "status IN ('RUMOR','UNVERIFIED','FIGHTER_CLAIM')"


def stories(spark, sf_dir):
    """Stories of line items under the headlines of their orders' articles."""
    heads = newsroom.articles(spark, sf_dir).select(F.col("id").alias("story"), F.col("title").alias("headline"), F.array("a", "b").alias("entities"))
    return evidence.rebuild_stories(items(spark, sf_dir), as_of()).join(heads, "story")


FEEDS_SQL = {
    "ALL": "true", "BREAKING": "is_breaking", "IMPORTANT": "relevance >= 55", "RUMORS": RUMORS, "DEVELOPING": "is_moving", "TRENDING": "is_trending", "FIGHT ANNOUNCEMENTS": "category = 'fight_announcement'", "INJURIES": "category = 'injury'",
    "RANKINGS": "category = 'ranking'", "TITLE": f"(category = 'title' OR {any_in('words', TITLE_TERMS)})", "RESULTS": "category = 'result'", "FIGHTERS": "category = 'fighter_statement'", "UFC BUSINESS": "category = 'business'", "CONTROVERSY": "category = 'controversy'",
}


@query(f"WITH {DESK} " + " UNION ALL ".join(f"SELECT '{name}' AS feed, count(*) AS n, coalesce(sum(story), 0)::BIGINT AS stories FROM desk WHERE {test}" for name, test in FEEDS_SQL.items()))
def flt_named_feeds(spark, sf_dir):
    """FLT-2, 3: what each of the fourteen feeds shows, in one pass."""
    rows = stories(spark, sf_dir)
    shown = {name: feeds.shows(rows, name) for name in feeds.NAMED}
    parts = [F.struct(F.count_if(c).alias("n"), F.coalesce(F.sum(F.when(c, F.col("story"))), F.lit(0)).alias("stories")).alias(name) for name, c in shown.items()]
    counts = rows.agg(*parts)
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("feed"), F.col(f"`{n}`.n").alias("n"), F.col(f"`{n}`.stories").alias("stories")) for n in shown))).alias("x")).select("x.*")


SORTS_SQL = {"Newest": "first_seen DESC", "Most Relevant": "relevance DESC, last_seen DESC", "Most Sources": "source_count DESC, last_seen DESC", "Most Discussed": "posts DESC, last_seen DESC", "Recently Updated": "last_seen DESC"}


@query(f"WITH {DESK} " + " UNION ALL ".join(f"SELECT '{name}' AS sort, story, (row_number() OVER (ORDER BY {order}, story))::INTEGER AS place FROM (SELECT * FROM desk WHERE {RUMORS} AND headline ILIKE '%costa%' ORDER BY {order}, story LIMIT 20)" for name, order in SORTS_SQL.items()))
def win_feed_sorts(spark, sf_dir):
    """FLT-1, WIN-4: the first twenty rumours about a name in each of the five orders; the cap is the feed's."""
    # what the feed shows in any order is worked out once; each order then reads these rows
    shown = feeds.feed(stories(spark, sf_dir), "RUMORS", search="Costa", sort=None)
    rows = keep(shown.select("story", "status", "headline", "category", *sorted({c for order in feeds.SORTS.values() for c in order})))
    parts = []
    for name in feeds.SORTS:
        first = feeds.feed(rows, "RUMORS", name, search="Costa", limit=20).agg(F.collect_list("story").alias("s"))  # twenty at most
        parts.append(first.select(F.lit(name).alias("sort"), F.posexplode("s").alias("place", "story")))
    return reduce(lambda a, b: a.unionByName(b), parts).select("sort", "story", (F.col("place") + 1).alias("place"))


@query(
    f"""WITH {DESK} SELECT count(*) AS stories, count(*) FILTER (is_breaking) AS breaking, count(*) FILTER (relevance >= 55) AS important, count(*) FILTER (status = 'CONFIRMED') AS confirmed, count(*) FILTER (status = 'CONTESTED') AS contested,
 count(*) FILTER ({RUMORS}) AS rumors, count(*) FILTER (is_moving) AS developing, count(*) FILTER (is_trending) AS trending, count(*) FILTER (date_diff('second', last_seen, TIMESTAMP '{AS_OF}') / 3600.0 <= 24) AS updated_today FROM desk"""
)
def agg_dashboard_counters(spark, sf_dir):
    """AGG-15: all nine."""
    return feeds.counters(stories(spark, sf_dir), as_of())


#: A year and a relevance that some stories of the tables reach.
SLOW_NEWS = EngineConfig(breaking_hours=24 * 365, breaking_relevance=40.0)


@query(f"WITH {ITEMS_SQL} SELECT story, relevance, category FROM stories WHERE {breaking_sql(24 * 365, 40)}")
def agg_breaking(spark, sf_dir):
    """AGG-21"""
    return evidence.rebuild_stories(items(spark, sf_dir), as_of(), SLOW_NEWS).filter("is_breaking").select("story", "relevance", "category")


def first_names(group: str, most: int) -> str:
    return f"array_to_string(list_sort(list(DISTINCT name) FILTER ({group}))[1:{most}], ', ')"


CREDIBLE_SQL = "source_type IN ('OFFICIAL','MAJOR_NEWS','ESTABLISHED_JOURNALIST','TRUSTED_REPORTER')"


@query(
    f"""WITH {ITEMS_SQL}, ev AS (SELECT story, kind, derivative, first(source_type ORDER BY t0, name, source_type) AS source_type, first(name ORDER BY t0, name, source_type) AS name FROM items GROUP BY story, kind, family, derivative),
nm AS (SELECT story, {first_names("source_type = 'OFFICIAL' AND NOT derivative", 3)} AS official, {first_names("kind <> 'news' AND source_type = 'OFFICIAL'", 3)} AS accounts, {first_names(f"kind = 'news' AND {CREDIBLE_SQL} AND NOT derivative", 5)} AS credible,
 {first_names("source_type IN ('UNKNOWN','FAN_ACCOUNT')", 4)} AS low, {first_names("source_type IN ('FIGHTER','COACH_TEAM','PROMOTER')", 3)} AS people FROM ev GROUP BY story)
SELECT story, {RUMORS} AS is_rumor, array_to_string(list_filter([CASE WHEN official_confirmed THEN 'official: ' || official END, CASE WHEN accounts <> '' THEN 'official accounts: ' || accounts END,
 CASE WHEN independent_count > 0 THEN independent_count || ' independent of ' || source_count || ' sources: ' || credible END, CASE WHEN social_count > 0 THEN social_count || ' posts, which count as no source' END,
 CASE WHEN copied_families > 0 THEN copied_families || ' copies of other outlets' END, CASE WHEN low <> '' AND independent_count = 0 THEN 'only low reliability: ' || low END, CASE WHEN people <> '' THEN 'first-person claim: ' || people END,
 CASE WHEN speculation >= 0.34 THEN 'hedged wording' END, CASE WHEN has_conflict THEN 'sources disagree' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM stories JOIN nm USING (story)"""
)
def agg_status_reasons(spark, sf_dir):
    """AGG-8"""
    rows = items(spark, sf_dir)
    found = evidence.status_reasons(evidence.rebuild_stories(rows, as_of()), evidence.build_evidence(rows))
    return found.select("story", "is_rumor", F.array_join("reasons", "; ").alias("reasons"))


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in TABLES))
def agg_table_counts(spark, sf_dir):
    """AGG-20"""
    return feeds.table_counts({t: table(spark, sf_dir, t) for t in TABLES})


KINDS = ["article", "social", "note", "card_change", "status_change"]
CALENDAR = "2024-01-20 00:00:00"


@query(
    f"""WITH t AS (SELECT user_id AS story, {chosen('event_id', KINDS)} AS kind, ts FROM events), r AS (SELECT story, count(*) FILTER (kind <> 'note' AND date_diff('microsecond', ts, TIMESTAMP '{CALENDAR}') / 3.6e9 <= 48) AS recent FROM t WHERE ts <= TIMESTAMP '{CALENDAR}' GROUP BY story)
SELECT c_custkey AS story, coalesce(recent, 0) AS recent, coalesce(recent, 0) >= 3 OR (c_nationkey % 2 = 0 AND coalesce(recent, 0) >= 2) AS is_developing FROM customer LEFT JOIN r ON story = c_custkey"""
)
def agg_developing(spark, sf_dir):
    """AGG-22"""
    e = table(spark, sf_dir, "events").filter(F.col("ts") <= F.lit(CALENDAR).cast("timestamp_ntz"))
    timeline = e.select(F.col("user_id").alias("story"), pick(F.col("event_id"), KINDS).alias("kind"), F.col("ts").cast("timestamp").alias("at"))
    conflicts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("story"), (F.col("c_nationkey") % 2 == 0).alias("has_conflict"))
    return evidence.developing(timeline, conflicts, F.lit(CALENDAR).cast("timestamp")).select("story", "recent", "is_developing")


@query(
    """SELECT o_orderkey AS story, bool_or(l_linenumber = 2) OR o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR max(l_shipdate) FILTER (l_linenumber <> 2) <> max(l_shipdate) AS changed
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1"""
)
def agg_fingerprint(spark, sf_dir):
    """AGG-25: a story's fingerprint follows from its status, headline, last update and members, however they are
    dealt, and from nothing else.  Every fifth story's status is another now, every seventh's headline."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("story"), F.col("l_linenumber").alias("id"), F.col("l_shipdate").alias("at"))

    def told(lines, fifth, seventh):
        k = F.col("story")
        rows = lines.groupBy("story").agg(F.max("at").alias("last_seen"))
        return rows.withColumns({"status": F.when(k % 5 == 0, fifth).otherwise("REPORTED"), "headline": F.concat(F.when(k % 7 == 0, seventh).otherwise("story "), k.cast("string"))})

    now = rebuild.story_prints(told(lines, "RUMOR", "report "), lines)
    same = rebuild.story_prints(told(lines.repartition(7), "RUMOR", "report "), lines.repartition(5))
    before = lines.filter("id <> 2")
    old = rebuild.story_prints(told(before, "CONTESTED", "story "), before).withColumnRenamed("fingerprint", "old")
    return now.join(same, ["story", "fingerprint"]).join(old, "story", "left").select("story", (~F.col("old").eqNullSafe(F.col("fingerprint"))).alias("changed"))


@query(f"WITH {ITEMS_SQL} SELECT story, coalesce(sum(engagement), 0)::BIGINT AS engagement, count(*) AS posts FROM items WHERE kind = 'social' GROUP BY story")
def agg_engagement(spark, sf_dir):
    """AGG-16"""
    return feeds.engagement(items(spark, sf_dir))


@query("SELECT event_id, value FROM events WHERE value IS NOT NULL ORDER BY value DESC, event_id LIMIT 25")
def win_top_posts(spark, sf_dir):
    """WIN-7: the 25 most engaged; the cap is the report's."""
    return feeds.top_posts(table(spark, sf_dir, "events"), "value", "event_id", 25).select("event_id", "value")


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' ORDER BY ts DESC, event_id LIMIT 50")
def flt_latest(spark, sf_dir):
    """FLT-4: the 50 latest; the cap is the feed's."""
    return feeds.latest(table(spark, sf_dir, "events"), F.col("ts"), F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), "event_id", 50).select("event_id", "user_id")


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 50)")
def set_difference(spark, sf_dir):
    """SET-3, JOIN-5"""
    e = table(spark, sf_dir, "events")
    return feeds.unseen(e.filter("event_type = 'view'"), e.filter("event_type = 'error' and value > 50"), "user_id")


@query("SELECT c_mktsegment AS system, count(*) AS n, min(year(o_orderdate))::INTEGER AS first_date, max(year(o_orderdate))::INTEGER AS last_date FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def agg_ranking_systems(spark, sf_dir):
    """AGG-13"""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return feeds.ranking_systems(o.select(F.col("c_mktsegment").alias("system"), F.year("o_orderdate").alias("at")), "system", "at")


@query(
    """WITH w AS (SELECT user_id, epoch(time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '1970-01-01'))::BIGINT AS bucket, count(*) AS items, count(DISTINCT event_type) AS families FROM events GROUP BY ALL)
SELECT user_id, bucket, items, families FROM w WHERE items >= 3"""
)
def agg_bursts(spark, sf_dir):
    """STRM-4 in batch: tumbling windows with three items or more."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return feeds.bursts(e, "user_id", "ts", "event_type").select("user_id", F.unix_seconds("w.start").alias("bucket"), "items", "families")


@query(
    """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS failed,
 CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 'SUCCESS' WHEN count(*) FILTER (event_type <> 'error') = 0 THEN 'TOTAL_FAILURE' ELSE 'PARTIAL' END AS outcome FROM events GROUP BY 1"""
)
def agg_run_outcomes(spark, sf_dir):
    """AGG-19"""
    return feeds.outcomes(table(spark, sf_dir, "events"), F.date_format("ts", "yyyy-MM-dd"), F.col("event_type") != "error").withColumnRenamed("run", "day")


@query("SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_checked, max(event_id) AS last_id, last(event_type || event_id ORDER BY ts, event_id) FILTER (event_type = 'error') AS last_error FROM events GROUP BY user_id")
def agg_poll_state(spark, sf_dir):
    """AGG-26, SRC-8"""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").cast("string").alias("post_id"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", F.concat("event_type", "event_id")).alias("error"))
    found = feeds.poll_state(e, "user_id")
    return found.select("user_id", F.date_format("last_checked", "yyyy-MM-dd HH:mm:ss").alias("last_checked"), F.col("last_post_id").cast("long").alias("last_id"), "last_error")


@query(
    f"""WITH {ITEMS_SQL}, p AS (SELECT story || '|' || name || '|' || strftime(t0, '%Y-%m-%d') || '|' || source_type || '|' || (speculation > 0) AS post, max(engagement) AS engagement, first(CASE WHEN source_type = 'OFFICIAL' THEN 'official'
 WHEN source_type IN ('ESTABLISHED_JOURNALIST','TRUSTED_REPORTER','MAJOR_NEWS') THEN 'journalist' WHEN source_type IN ('FIGHTER','COACH_TEAM') THEN 'fighter' WHEN speculation > 0 THEN 'rumour' ELSE 'other' END) AS grp FROM items WHERE kind = 'social' GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY engagement DESC NULLS LAST, post) AS place FROM p) SELECT grp, post, place::INTEGER AS place FROM r WHERE place <= 6"""
)
def flt_radar_groups(spark, sf_dir):
    """FLT-9, WIN-7: the six most engaged posts of each kind of account; the cap is the report's."""
    posts = items(spark, sf_dir).filter("kind = 'social'")
    post = F.concat_ws("|", "story", "name", F.date_format("at", "yyyy-MM-dd"), "source_type", F.col("speculation") > 0)
    unique = posts.groupBy(post.alias("post"), F.col("source_type").alias("account_type"), (F.col("speculation") > 0).cast("double").alias("speculation_score")).agg(F.max("engagement").alias("engagement"))
    return cards.radar_groups(unique).select("grp", "post", "place")


@query(
    f"""WITH {ITEMS_SQL}
SELECT story, count(*) AS items, count(DISTINCT family) AS families, max(t0) = min(t0) AS one_day FROM items WHERE kind = 'news' GROUP BY story HAVING count(DISTINCT family) >= 3"""
)
def agg_trending_families(spark, sf_dir):
    """STRM-3 in batch: stories that three families report."""
    news = items(spark, sf_dir).filter("kind = 'news'")
    return news.groupBy("story").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("family").alias("families"), (F.max("at") == F.min("at")).alias("one_day")).filter("families >= 3")


@query(
    """WITH b AS (SELECT page_id, regexp_replace(html, '(?is)<(?:script|style|nav|header|footer|aside|form)\\b.*?</(?:script|style|nav|header|footer|aside|form)>', ' ', 'g') AS h FROM pages),
p AS (SELECT page_id, regexp_extract_all(h, '(?is)<p(?:\\s[^>]*)?>(.*?)</p>', 1) AS ps FROM b)
SELECT page_id, len(ps)::BIGINT AS n_paragraphs FROM p"""
)
def src_paragraphs(spark, sf_dir):
    """SRC-6, up to the paragraphs."""
    from ..sources import landing

    return table(spark, sf_dir, "pages").select("page_id", F.size(landing.paragraphs(F.col("html"))).cast("long").alias("n_paragraphs"))


@query(f"WITH {ARTICLES} SELECT sha1('https://example.com/news/' || (id % 500) || '?a=' || {newsroom.CUSTOMER_SQL} || '&b=2') AS url_hash, count(*) AS n FROM art GROUP BY 1")
def dup_url_groups(spark, sf_dir):
    """DUP-1: how many articles each canonical address has."""
    return newsroom.articles(spark, sf_dir).groupBy(url.url_hash(F.col("url")).alias("url_hash")).agg(F.count(F.lit(1)).alias("n"))


STATES = ["UPCOMING", "LIVE", "COMPLETED", "UNKNOWN", "CANCELLED", "POSTPONED"]


def events(spark, sf_dir):
    """An event for every order: some without a start, some without a date, some merged into another."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("event"), pick(k, STATES).alias("status"), F.when(k % 5 > 0, F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=(k % 24).cast("int"))).alias("start"), F.when(k % 7 > 0, F.to_date("o_orderdate")).alias("event_date"),
        F.when(k % 11 == 0, k - 1).alias("merged_into"), F.when(k % 13 == 0, F.array(F.lit("date"), F.col("o_orderstatus"))).alias("conflicts"),
    )


EVENTS = f"""ev AS (SELECT o_orderkey AS event, {chosen('o_orderkey', STATES)} AS status, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate + to_hours(o_orderkey % 24) END AS start, CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate END AS day,
 o_orderkey % 11 = 0 AS merged, CASE WHEN o_orderkey % 13 = 0 THEN ['date', o_orderstatus] END AS conflicts FROM orders)"""


@query(f"WITH {EVENTS} SELECT event, row_number() OVER (ORDER BY coalesce(start, day) ASC NULLS LAST, event)::INTEGER AS place FROM ev WHERE NOT merged AND status IN ('UPCOMING', 'LIVE', 'POSTPONED', 'UNKNOWN') ORDER BY place LIMIT 200")
def flt_events(spark, sf_dir):
    """FLT-6: the first 200 events still ahead by their status; the cap is the listing's."""
    first = feeds.list_events(events(spark, sf_dir), upcoming=True, limit=200).agg(F.collect_list("event").alias("e"))
    return first.select(F.posexplode("e").alias("place", "event")).select("event", (F.col("place") + 1).alias("place"))


@query(
    f"""WITH {ARTICLES}, u AS (SELECT id, CASE WHEN id % 3 = 0 THEN url END AS good, CASE WHEN id % 2 = 0 THEN url ELSE 'http://a.org/feed' END AS usual, CASE WHEN id % 5 > 0 THEN ['', 'http://b.org/feed', 'http://a.org/feed'] ELSE [] END AS rest, a, b FROM art),
l AS (SELECT *, list_filter(list_concat([good, usual], rest), lambda x: x IS NOT NULL AND x <> '') AS every FROM u)
SELECT id, array_to_string(list_filter(every, lambda x, i: list_position(every, x) = i), ' ') AS urls FROM l WHERE a = 'Carla Costa' OR b = 'Carla Costa'"""
)
def flt_lookup(spark, sf_dir):
    """FLT-7, 8: the articles of one person, with the addresses to try."""
    k, u = F.col("id"), F.col("url")
    rows = newsroom.articles(spark, sf_dir).withColumn("people", F.array("a", "b"))
    found = feeds.lookup(rows, "people", "Carla Costa", [F.col("at").desc(), k])
    fallbacks = F.when(k % 5 > 0, F.array(F.lit(""), F.lit("http://b.org/feed"), F.lit("http://a.org/feed")))
    tried = feeds.candidate_urls(F.when(k % 3 == 0, u), F.when(k % 2 == 0, u).otherwise(F.lit("http://a.org/feed")), fallbacks)
    return found.select("id", F.array_join(tried, " ").alias("urls"))


LISTED = "SELECT event_id, lpad(CAST(event_id AS VARCHAR), 9, '0') AS name, user_id AS mentions, CASE WHEN event_id % 4 > 0 THEN ts END AS last_mentioned FROM events"
ORDERS_SQL = {"name": "name", "mentions": "mentions DESC NULLS LAST, name", "recent": "last_mentioned DESC NULLS LAST, name"}


@query(" UNION ALL ".join(f"SELECT '{by}' AS listing, event_id AS entity, (row_number() OVER (ORDER BY {order}))::INTEGER AS place FROM (SELECT * FROM ({LISTED}) ORDER BY {order} LIMIT 100)" for by, order in ORDERS_SQL.items()))
def win_entity_listing(spark, sf_dir):
    """WIN-8: the first hundred of each listing; the cap is the listing's."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("entity"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("name"), F.col("user_id").alias("mentions"), F.when(F.col("event_id") % 4 > 0, F.col("ts")).alias("last_mentioned"))
    first = lambda by: entities.entity_listing(e, by).limit(100).agg(F.collect_list("entity").alias("e")).select(F.lit(by).alias("listing"), F.posexplode("e").alias("place", "entity"))
    return reduce(lambda a, b: a.unionByName(b), map(first, ORDERS_SQL)).select("listing", "entity", (F.col("place") + 1).alias("place"))


@query(
    """SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS id FROM documents WHERE text ILIKE '%re%' UNION ALL SELECT 'page', CAST(page_id AS VARCHAR) FROM pages WHERE url ILIKE '%re%' UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR) FROM part WHERE p_name ILIKE '%re%'
UNION ALL SELECT 'post', CAST(event_id AS VARCHAR) FROM events WHERE event_type ILIKE '%re%' UNION ALL SELECT 'account', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment ILIKE '%re%' UNION ALL SELECT 'event', CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_name ILIKE '%re%'"""
)
def flt_search_all(spark, sf_dir):
    """FLT-5: all six kinds."""
    kinds = {"document": ("documents", "doc_id", "text"), "page": ("pages", "page_id", "url"), "part": ("part", "p_partkey", "p_name"), "post": ("events", "event_id", "event_type"), "account": ("customer", "c_custkey", "c_mktsegment"), "event": ("nation", "n_nationkey", "n_name")}
    return feeds.search({k: (table(spark, sf_dir, t), i, c) for k, (t, i, c) in kinds.items()}, "re").drop("label")
