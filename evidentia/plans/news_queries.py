"""Queries over derived articles: wording, classification, entities, sources, sinks (2.1 to 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, timefn
from ..functions.url import url_hash
from ..lexicons import BREAKING_CATEGORIES, CATEGORIES, CREDITS, DECISIVE, DENIAL, FUTURE_TERMS, INTENT_ORDER, INTENTS, OFFICIAL, OUTLETS, PRIORITY, PUBLISHERS, RELIABLE, RESULT_VERBS, SPECULATION
from ..operators import cards, classify, entities, feeds, matching
from ..sources import landing
from ..sources.scratch import new_folder
from . import newsroom
from .newsroom import ARTICLES, chosen, listed
from .registry import constants, query, table
from .shapes import WEIGHT_SQL, pick
from .text_queries import norm

STRIP = "trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


def strip_sql(c: str) -> str:
    """STR-1 in SQL."""
    bare = f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"
    for name, sign in text.ENTITIES.items():
        bare = f"replace({bare}, {newsroom.text(name)}, {newsroom.text(sign)})"
    return STRIP.format(e=bare)


def title_sql(c: str) -> str:
    """STR-5 in SQL."""
    names = "|".join(p.replace(" ", "\\s?") for p in PUBLISHERS)
    return f"trim(regexp_replace({strip_sql(c)}, '(?i)(?:\\s*[|–—-]\\s*(?:{names})(?:\\.com)?\\s*)+$', ''))"


def hit(c: str, term: str) -> str:
    t = classify.plain(term)
    return f"contains(' ' || {c} || ' ', ' {t} ')" if len(t) <= 4 else f"contains({c}, '{t}')"


def any_hit(c: str, terms: list[str]) -> str:
    return "(" + " OR ".join(hit(c, t) for t in terms) + ")"


def any_in(c: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{t}')" for t in terms) + ")"


def score_sql(title: str, body: str, terms: list[str]) -> str:
    return " + ".join(f"CASE WHEN {hit(title, t)} THEN 3 WHEN {hit(body, t)} THEN 1 ELSE 0 END" for t in terms)


def pick_sql(title: str) -> str:
    firm = " ".join(f"WHEN {any_hit(title, CATEGORIES[g])} THEN '{g}'" for g in DECISIVE)
    best = "greatest(" + ", ".join(f"c_{g}" for g in PRIORITY) + ")"
    return f"CASE {firm} WHEN {best} = 0 THEN 'general' " + " ".join(f"WHEN c_{g} = {best} THEN '{g}'" for g in PRIORITY) + " END"


def pattern(terms: list[str]) -> str:
    return "'" + text.words_pattern(terms).replace("'", "''") + "'"


def credits_sql(raw: str, own: str) -> str:
    phrases = "|".join(words.replace(" ", r"\s+") for words in CREDITS)
    said = rf"\b(?:{phrases})\s+({text.run_of(text.CAPITALISED, 4)})".replace("'", "''")
    known = " ".join(f"WHEN contains({norm('x')}, '{classify.plain(o)}') AND NOT contains({norm(own)}, '{classify.plain(o)}') THEN {newsroom.text(o)}" for o in OUTLETS)
    return f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({raw}, '{said}', 1), lambda x: CASE {known} END), lambda x: x IS NOT NULL)))"


def lexicon_sql(title: str, body: str, lexicon: dict[str, list[str]], prefix: str) -> str:
    return ", ".join(f"{score_sql(title, body, terms)} AS {prefix}{g}" for g, terms in lexicon.items())


SPECULATED = "round(least(1.0, (" + " + ".join(f"CASE WHEN {hit('x', t)} THEN 1 ELSE 0 END" for t in SPECULATION) + ") / 3.0), 3)::DOUBLE"
LEAD = "greatest(" + ", ".join(f"i_{g}" for g in INTENT_ORDER) + ")"
LEADER = f"CASE WHEN {LEAD} = 0 THEN 'UNKNOWN' " + " ".join(f"WHEN i_{g} = {LEAD} THEN '{g}'" for g in INTENT_ORDER) + " END"
ENRICHED = f"""{ARTICLES}, clean AS (SELECT * REPLACE ({title_sql('title')} AS title) FROM art),
n AS (SELECT *, {norm('title')} AS t, {norm('body')} AS w FROM clean), s AS (SELECT *, t || ' ' || w AS x, {lexicon_sql('t', 'w', CATEGORIES, 'c_')}, {lexicon_sql('t', 'w', INTENTS, 'i_')} FROM n),
e AS (SELECT *, {pick_sql('t')} AS category_raw, {SPECULATED} AS speculation_score, {any_in('x', [classify.plain(t) for t in OFFICIAL])} AS has_official_language, {any_in('x', [classify.plain(t) for t in DENIAL])} AS has_denial,
 {credits_sql("title || ' ' || body", 'source_name')} AS outlets, {LEADER} AS leader, regexp_matches(title, {pattern(RESULT_VERBS)}) AS verb, regexp_matches(title, {pattern(FUTURE_TERMS)}) AS ahead, regexp_matches(body, {pattern(RESULT_VERBS)}) AS told,
 {any_hit('t', INTENTS['PREDICTION'])} AS predicts, {any_hit('t', INTENTS['PREVIEW'])} AS previews,
 list_sort(list_distinct(list_filter([{', '.join(f"CASE WHEN {hit('t', k)} OR {hit('w', k)} THEN {newsroom.text(k)} END" for g in CATEGORIES.values() for k in g)}], lambda k: k IS NOT NULL)))[1:12] AS keywords,
 CASE source_name WHEN 'MMA Fighting' THEN 'MAJOR_NEWS' WHEN 'ESPN' THEN 'MAJOR_NEWS' WHEN 'UFC' THEN 'OFFICIAL' WHEN 'Fan Blog' THEN 'FAN_ACCOUNT' WHEN 'Ariel Helwani' THEN 'ESTABLISHED_JOURNALIST' ELSE 'UNKNOWN' END AS typed FROM s),
i AS (SELECT *, CASE WHEN predicts THEN 'PREDICTION' WHEN regexp_matches(title, '\\?\\s*$') AND i_RESULT > 0 THEN 'PREVIEW' WHEN ahead AND (verb OR i_RESULT > 0 OR previews) THEN 'PREVIEW' WHEN previews AND NOT verb THEN 'PREVIEW'
 WHEN leader = 'RESULT' AND NOT verb AND NOT told THEN 'PREVIEW' ELSE leader END AS intent FROM e),
enriched AS (SELECT *, CASE WHEN category_raw = 'result' AND intent IN ('PREVIEW', 'PREDICTION') THEN 'general' ELSE category_raw END AS category FROM i)"""


def cleaned(spark, sf_dir):
    return newsroom.articles(spark, sf_dir).withColumns({"title": text.clean_title(F.col("title")), "source_type": classify.source_type(F.col("source_type"))})


def enriched(spark, sf_dir):
    return classify.enrich(cleaned(spark, sf_dir))


@query(
    f"""WITH {ENRICHED} SELECT id, title, category, intent, speculation_score, has_official_language, has_denial, array_to_string(keywords, '|') AS keywords, array_to_string(outlets, '|') AS outlets, len(outlets) > 0 AS is_derivative,
 typed = 'OFFICIAL' AND len(outlets) = 0 AS is_official, category IN ('promo', 'interview') AS promotional, intent IN ('RESULT', 'POST_FIGHT') AND typed IN ({', '.join(map(newsroom.text, RELIABLE))}) AS may_establish_result FROM enriched"""
)
def cls_enrich(spark, sf_dir):
    """CLS-1 to 10, CLS-12, STR-5: the article job."""
    outlets = F.array_join(F.array_sort("attribution_outlets"), "|").alias("outlets")
    rows = enriched(spark, sf_dir)
    return rows.select(
        "id", "title", "category", "intent", "speculation_score", "has_official_language", "has_denial", F.array_join("keywords", "|").alias("keywords"), outlets, "is_derivative", "is_official",
        classify.is_promotional(F.col("category")).alias("promotional"), "may_establish_result",
    )


def said_terms(terms: list[str]) -> str:
    each = ", ".join(f"CASE WHEN contains(x, '{classify.plain(t)}') THEN {newsroom.text(t)} END" for t in terms)
    return f"array_to_string(list_sort(list_distinct(list_filter([{each}], lambda k: k IS NOT NULL))), '|')"


@query(
    f"""WITH {ENRICHED} SELECT id, {said_terms(OFFICIAL)} AS official_terms, {said_terms(DENIAL)} AS denial_terms,
 array_to_string(list_concat(['Own ' || id % 3, 'injury'], list_filter(keywords, lambda k: k <> 'injury'))[1:15], '|') AS keywords FROM enriched"""
)
def cls_terms(spark, sf_dir):
    """CLS-4, 10: the terms behind the flags, and keywords merged with the article's own."""
    own = F.array(F.concat(F.lit("Own "), (F.col("id") % 3).cast("string")), F.lit("injury"))
    rows = newsroom.articles(spark, sf_dir).withColumns({"title": text.clean_title(F.col("title")), "keywords": own})
    return classify.enrich(rows).select("id", *(F.array_join(c, "|").alias(c) for c in ("official_terms", "denial_terms", "keywords")))


ACCOUNTS = [("@espn ", "Trusted Journalist"), ("UFC", "OFFICIAL")]
CLASSES = [("x_account", "fan blog", "FAN_ACCOUNT"), ("x_account", "espn", "UNKNOWN"), ("domain", "somebody", "OFFICIAL")]


@query(
    f"""WITH {ARTICLES}, p AS (SELECT id, title || '. ' || body AS text, source_name, lower(source_name) AS handle FROM art), n AS (SELECT *, {norm('text')} AS t, '' AS b FROM p),
s AS (SELECT *, t AS x, {lexicon_sql('t', 'b', CATEGORIES, 'c_')} FROM n),
k AS (SELECT *, CASE handle WHEN 'espn' THEN 'ESTABLISHED_JOURNALIST' WHEN 'ufc' THEN 'OFFICIAL' WHEN 'fan blog' THEN 'FAN_ACCOUNT' ELSE 'UNKNOWN' END AS source_type FROM s)
SELECT id, source_type AS account_type, {pick_sql('t')} AS category, {SPECULATED} AS speculation_score, {any_in('x', [classify.plain(t) for t in DENIAL])} AS has_denial, array_to_string({credits_sql('text', 'source_name')}, '|') AS outlets, {WEIGHT_SQL}::DOUBLE AS reliability_weight FROM k"""
)
def cls_posts(spark, sf_dir):
    """CLS-11, JOIN-3: posts with the kind of their account."""
    posts = newsroom.articles(spark, sf_dir).select("id", F.concat("title", F.lit(". "), "body").alias("text"), F.col("source_name").alias("username"))
    accounts, classes = constants(spark, ACCOUNTS, "username string, account_type string"), constants(spark, CLASSES, "kind string, normalized_id string, classification string")
    rows = classify.enrich_posts(entities.account_types(posts, accounts, classes))
    return rows.select("id", "account_type", "category", "speculation_score", "has_denial", F.array_join(F.array_sort("attribution_outlets"), "|").alias("outlets"), "reliability_weight")


CUT = 60


@query(
    f"""WITH {ARTICLES}, c AS (SELECT *, {strip_sql('body')} AS plain FROM art), d AS (SELECT *, string_split(regexp_replace(plain, '([.!?])\\s+([A-Z0-9"''“])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS s FROM c),
k AS (SELECT *, coalesce(list_max(list_filter(range(1, len(s) + 1), lambda n: length(array_to_string(s[1:n], ' ')) <= {CUT})), 0) AS fit, [a, b, upper(a), b || ' ', lower(b), 'Carla Costa'] AS names,
  regexp_replace(regexp_replace(title, '(?i)^(?:report|breaking|update|exclusive|rumou?r|sources)\\s*:\\s*', ''), '(?i)[,\\s]+(?:per|according to)\\s+(?:multiple\\s+)?sources?\\.?$', '') AS claim FROM d)
SELECT id, plain, {title_sql('title')} AS headline, {norm(title_sql('title'))} AS normal, CASE WHEN fit > 0 THEN array_to_string(s[1:fit], ' ') WHEN length(plain) > {CUT} THEN regexp_replace(regexp_replace(substr(plain, 1, {CUT} - 3), ' [^ ]*$', ''), '[ ,.;:-]+$', '') || '...' ELSE plain END AS excerpt,
 array_to_string(list_filter(regexp_extract_all(body, '["“]([^"“”]{{10,400}})["”]', 1), lambda q: len(regexp_split_to_array(trim(q), '\\s+')) >= 4), '|') AS quotes,
 CASE WHEN {norm('a')} = {norm('b')} OR 'carla costa' IN ({norm('a')}, {norm('b')}) THEN 1.0 ELSE 0.5 END::DOUBLE AS similarity,
 array_to_string(list_filter(names, lambda x, i: list_position(list_transform(names, lambda y: {norm('y')}), {norm('x')}) = i)[1:2], '|') AS merged, upper(claim[1]) || claim[2:] AS claim FROM k"""
)
def str_wording(spark, sf_dir):
    """STR-1, 5, 6, 11, 12, 15, 16, 17"""
    rows = newsroom.articles(spark, sf_dir)
    body, title = F.col("body"), F.col("title")
    names, more = F.array("a", "b", F.upper("a"), F.concat("b", F.lit(" "))), F.array(F.lower("b"), F.lit("Carla Costa"))
    return rows.select(
        "id", text.strip_html(body).alias("plain"), text.clean_title(title).alias("headline"), text.normalize_title(title).alias("normal"), text.excerpt(text.strip_html(body), CUT).alias("excerpt"), F.array_join(text.quotes(body), "|").alias("quotes"),
        text.set_similarity(F.array("a", "b"), F.array("b", F.lit("CARLA Costa"))).alias("similarity"), F.array_join(text.merge_lists(names, more, 2), "|").alias("merged"), text.clean_claim(title).alias("claim"),
    )


FORMS = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "E, dd MMM yyyy HH:mm:ss 'GMT'", "dd MMM yyyy HH:mm:ss '+0200'", "yyyy-MM-dd", "'on 'E' the 'd"]
VENUES = ["America/New_York", "Europe/Paris", "Nowhere/None"]
PRINTED = ["Doors 6 PM EST", "October 31, 2026, CEST", "from 2026-10-31 on", "JST or CET", "tba"]
PLACES = ["T-Mobile Arena, Las Vegas, Nevada", "Paris", " Arena ,Abu Dhabi", ""]
FALLBACK = ["", "http://b.org/feed", "http://a.org/feed"]


@query(
    f"""WITH {ARTICLES}, t AS (SELECT *, CASE id % 6 WHEN 3 THEN t0 - INTERVAL 2 HOURS WHEN 4 THEN date_trunc('day', t0) WHEN 5 THEN NULL ELSE t0 END AS parsed, {chosen('id', VENUES)} AS venue, {chosen('id // 2', PRINTED)} AS printed, {chosen('id // 3', PLACES)} AS place,
 date_diff('second', t0, TIMESTAMP '{newsroom.NOW}') AS age, [epoch(t0)::BIGINT + 7200, epoch(t0)::BIGINT, epoch(t0)::BIGINT + 3600] AS epochs FROM art),
l AS (SELECT *, abs(age) // 60 AS m, list_filter(list_transform(string_split(place, ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM t)
SELECT id, strftime(parsed, '%Y-%m-%dT%H:%M:%SZ') AS parsed, strftime(CASE venue WHEN 'Nowhere/None' THEN t0 ELSE timezone(venue, timezone('UTC', t0)) END, '%Y-%m-%d %H:%M') AS local,
 CASE WHEN m < 1 THEN 'just now' ELSE CASE WHEN age < 0 THEN 'in ' ELSE '' END || CASE WHEN m < 60 THEN m || 'm' WHEN m < 1440 THEN (m // 60) || 'h' ELSE (m // 1440) || 'd' END || CASE WHEN age < 0 THEN '' ELSE ' ago' END END AS label,
 CASE printed WHEN '{PRINTED[0]}' THEN 'America/New_York' WHEN '{PRINTED[1]}' THEN 'Europe/Paris' WHEN '{PRINTED[3]}' THEN 'Asia/Tokyo' END AS zone, CASE WHEN contains(printed, '31') THEN '2026-10-31' END AS shown,
 CASE WHEN len(parts) > 1 THEN array_to_string(parts[2:], ', ') WHEN len(parts) = 1 THEN parts[1] END AS city,
 CASE WHEN id % 4 = 3 THEN NULL WHEN id % 4 = 0 THEN epochs[1] WHEN id % 4 = 1 THEN least(epochs[1], epochs[2]) ELSE list_min(epochs) END AS start,
 CASE WHEN id % 4 = 3 THEN CASE WHEN contains(printed, '31') THEN '2026-10-31' END ELSE strftime(CASE id % 4 WHEN 0 THEN t0 + INTERVAL 2 HOURS ELSE t0 END, '%Y-%m-%d') END AS day FROM l"""
)
def dt_texts(spark, sf_dir):
    """DT-1, 2, 6, 7, 9, 10"""
    at, k = F.col("at"), F.col("id")
    written = F.coalesce(*(F.when(k % len(FORMS) == n, F.date_format(at, form)) for n, form in enumerate(FORMS)))
    epoch = F.unix_seconds("at")
    main, prelims, early = (F.when(k % 4 != 3, epoch + 7200), F.when((k % 4).isin(1, 2), epoch), F.when(k % 4 == 2, epoch + 3600))
    rows = newsroom.articles(spark, sf_dir).withColumns({"printed": pick(F.floor(k / 2), PRINTED), "venue": pick(k, VENUES), "place": pick(F.floor(k / 3), PLACES)})
    plan = timefn.schedule(early, prelims, main, F.col("printed"))
    return rows.select(
        "id", timefn.to_iso(timefn.parse_time(written)).alias("parsed"), F.date_format(timefn.to_zone(at, F.col("venue"), VENUES[:2]), "yyyy-MM-dd HH:mm").alias("local"), timefn.humanize_age(at, newsroom.now()).alias("label"),
        timefn.zone_of(F.col("printed")).alias("zone"), timefn.printed_date(F.col("printed")).cast("string").alias("shown"), timefn.city_of(F.col("place")).alias("city"), F.unix_seconds(plan["start"]).alias("start"), plan["date"].cast("string").alias("day"),
    )


FEEDS = [("a.org", "MAJOR_NEWS", 0.85, "alpha"), ("b.org", "FAN_ACCOUNT", 0.15, "beta")]
HOSTS = ["a.org", "b.org", "c.org"]
TOPIC = ["ufc", "title"]


@query(
    f"""WITH {ARTICLES}, f AS (SELECT id, {title_sql('title')} AS title, CASE WHEN id % 9 = 0 THEN NULL WHEN id % 9 = 1 THEN 'ftp://x' ELSE url END AS url, {chosen('id', HOSTS)} AS host, t0, {strip_sql('body')} AS snippet FROM art),
v AS (SELECT * FROM f WHERE url LIKE 'http%' AND length(trim(title)) >= 8 AND (contains({norm("title || ' ' || snippet")}, 'ufc') OR contains({norm("title || ' ' || snippet")}, 'title')))
SELECT id, title, url, strftime(t0, '%Y-%m-%dT%H:%M:%SZ') AS published, 'Staff ' || (id % 7) AS author, (id % 15) % 13::BIGINT AS n_tags, snippet, host AS publisher, CASE host WHEN 'a.org' THEN 'MAJOR_NEWS' WHEN 'b.org' THEN 'FAN_ACCOUNT' ELSE 'UNKNOWN' END AS classification,
 CASE host WHEN 'a.org' THEN 0.85 WHEN 'b.org' THEN 0.15 ELSE 0.3 END::DOUBLE AS weight, CASE host WHEN 'a.org' THEN 'alpha' WHEN 'b.org' THEN 'beta' ELSE 'c.org' END AS family FROM v"""
)
def src_feed(spark, sf_dir):
    """SRC-1 to 4: landed items in the shape of articles, valid and on topic, with their publisher's class."""
    rows = newsroom.articles(spark, sf_dir)
    k, none = F.col("id"), F.lit(None).cast("string")
    items = rows.select(
        "title", F.when(k % 9 == 1, F.lit("ftp://x")).when(k % 9 != 0, F.col("url")).alias("link"), none.alias("guid"), F.date_format("at", "E, dd MMM yyyy HH:mm:ss 'GMT'").alias("pubDate"), none.alias("updated"),
        F.concat(F.lit("By Staff "), (k % 7).cast("string")).alias("creator"), F.concat(F.col("body"), F.lit("<br/>")).alias("description"), k.cast("string").alias("media_url"), F.transform(F.sequence(F.lit(1), F.lit(15)), lambda n: n.cast("string")).alias("every"),
    )
    items = items.withColumn("category", F.slice("every", 1, (F.col("media_url").cast("long") % 15 % 13).cast("int"))).drop("every")
    found = landing.feed_items(items).filter(landing.is_valid_item(F.col("url"), F.col("title")) & landing.on_topic(F.col("title"), F.col("content_snippet"), TOPIC))
    publishers = constants(spark, FEEDS, "normalized_id string, classification string, reliability_weight double, independence_group string")
    typed = landing.attribute_publisher(found.withColumn("publisher_domain", pick(F.col("image_url").cast("long"), HOSTS)), publishers)
    return typed.select(
        F.col("image_url").cast("long").alias("id"), "title", "url", timefn.to_iso(F.col("published_at")).alias("published"), "author", F.size("tags").cast("long").alias("n_tags"), F.col("content_snippet").alias("snippet"),
        F.col("publisher_domain").alias("publisher"), "classification", F.col("reliability_weight").alias("weight"), F.col("independence_group").alias("family"),
    )


@query(
    """SELECT CAST(event_id AS VARCHAR) AS post_id, CASE WHEN user_id % 3 > 0 THEN 'user' || user_id END AS username, event_type AS text, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS created_at, CAST(floor(value) AS BIGINT) AS like_count, event_id % 7 AS repost_count,
 least(10, event_id % 13)::BIGINT AS n_hashtags FROM events"""
)
def src_posts(spark, sf_dir):
    """SRC-5: pages of an API, each with a post and, for two of three users, its author."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    metrics = F.struct(F.floor("value").alias("like_count"), (k % 7).alias("retweet_count"))
    tags = F.transform(F.slice(F.sequence(F.lit(1), F.lit(13)), 1, (k % 13).cast("int")), lambda n: F.struct(n.cast("string").alias("tag")))
    post = F.struct(k.cast("string").alias("id"), F.col("event_type").alias("text"), F.col("user_id").cast("string").alias("author_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.000'Z'").alias("created_at"), metrics.alias("public_metrics"), F.struct(tags.alias("hashtags")).alias("entities"))
    user = F.struct(F.when(F.col("user_id") % 3 > 0, F.col("user_id")).otherwise(F.lit(-1)).cast("string").alias("id"), F.concat(F.lit("user"), F.col("user_id")).alias("username"))
    pages = e.select(F.to_json(F.struct(F.array(post).alias("data"), F.struct(F.array(user).alias("users")).alias("includes"))).alias("payload"))
    return landing.posts(pages).select("post_id", "username", "text", timefn.to_iso(F.col("created_at")).alias("created_at"), "like_count", "repost_count", F.size("hashtags").cast("long").alias("n_hashtags"))


BLOCKS = "script|style|nav|header|footer|aside|form"


@query(
    f"""WITH b AS (SELECT page_id, regexp_replace(html, '(?is)<(?:{BLOCKS})\\b.*?</(?:{BLOCKS})>', ' ', 'g') AS h FROM pages),
p AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(h, '(?is)<p(?:\\s[^>]*)?>(.*?)</p>', 1), lambda x: {strip_sql('x')}), lambda x: length(x) > 60) AS ps FROM b)
SELECT page_id, md5(substr(array_to_string(ps[1:12], ' '), 1, 1500)) AS text, length(substr(array_to_string(ps[1:12], ' '), 1, 1500))::BIGINT AS n FROM p"""
)
def src_main_text(spark, sf_dir):
    """SRC-6: the main text itself."""
    rows = table(spark, sf_dir, "pages").select("page_id", landing.main_text(F.col("html")).alias("m"))
    return rows.select("page_id", F.md5(F.col("m").cast("binary")).alias("text"), F.length("m").cast("long").alias("n"))


@query(
    f"""WITH {ARTICLES} SELECT id, strftime(t0, '%Y-%m-%d %H') AS at FROM art WHERE t0 >= TIMESTAMP '{newsroom.NOW}' - INTERVAL 24 HOURS AND length(body) < 90 AND {chosen('id', ['0.85', '0.15'])}::DOUBLE >= 0.5 AND {chosen('id', HOSTS)} <> 'b.org' ORDER BY t0 DESC, url LIMIT 25"""
)
def src_thin_articles(spark, sf_dir):
    """SRC-7: the newest 25; the cap is the report's."""
    rows = newsroom.articles(spark, sf_dir).withColumns({"published_at": F.col("at"), "reliability_weight": pick(F.col("id"), ["0.85", "0.15"]).cast("double"), "domain": pick(F.col("id"), HOSTS), "content_snippet": F.when(F.length("body") < 90, F.lit("short")).otherwise(F.repeat(F.lit("long"), F.lit(100)))})
    return landing.thin_articles(rows, newsroom.now(), ["b.org"], 25).select("id", F.date_format("at", "yyyy-MM-dd HH").alias("at"))


@query("SELECT user_id, last(CAST(event_id AS VARCHAR) ORDER BY length(CAST(event_id AS VARCHAR)), CAST(event_id AS VARCHAR)) AS newest_id FROM events GROUP BY user_id")
def src_newest(spark, sf_dir):
    """SRC-8"""
    return landing.newest_ids(table(spark, sf_dir, "events").select("user_id", F.col("event_id").cast("string").alias("post_id")), "user_id")



CANON = "'https://example.com/news/' || (id % 500) || '?a=' || c || '&b=2'"


@query(
    f"""WITH {ARTICLES}, k AS (SELECT *, {newsroom.CUSTOMER_SQL} AS c FROM art), h AS (SELECT *, sha1({CANON}) AS url_hash FROM k), f AS (SELECT *, row_number() OVER (PARTITION BY url_hash ORDER BY t0, url, title) AS r FROM h WHERE id % 4 > 0 AND id % 11 > 0)
SELECT url_hash, id FROM f WHERE r = 1 AND url_hash NOT IN (SELECT url_hash FROM h WHERE id % 4 = 0)"""
)
def snk_insert_articles(spark, sf_dir):
    """SNK-1, DUP-1, URL-1, 2: articles whose canonical address the store doesn't have; those without one are rejected."""
    rows = newsroom.articles(spark, sf_dir).withColumn("collected_at", F.col("at"))
    store = rows.filter("id % 4 = 0").select(url_hash(F.col("url")).alias("url_hash"))
    new = rows.filter("id % 4 > 0").withColumn("url", F.when(F.col("id") % 11 > 0, F.col("url")))
    return matching.insert_if_absent(new, store).select("url_hash", "id")


@query("SELECT user_id, event_type, first(event_id ORDER BY ts, event_id) AS first_event, last(value ORDER BY ts, value) FILTER (value IS NOT NULL) AS value, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS at FROM events GROUP BY ALL")
def snk_post_upsert(spark, sf_dir):
    """SNK-2: a post keeps its first row's columns and takes the latest metric."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.lpad(F.col("event_id").cast("string"), 12, "0").alias("first_event"), "value", "ts")
    done = feeds.upsert_posts(e.filter("day(ts) <= 15"), e.filter("day(ts) > 15"), ["user_id", "event_type"], ["value"], "ts")
    return done.select("user_id", "event_type", F.col("first_event").cast("long").alias("first_event"), "value", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(
    """WITH t AS (SELECT conv_id, role AS kind, turn, text AS headline, sha1(role || '|' || (turn % 2) || '|' || text || '|' || conv_id) AS k FROM conversations)
SELECT conv_id AS story, k AS dedup_key FROM t WHERE turn > 1 GROUP BY ALL HAVING k NOT IN (SELECT k FROM t WHERE turn <= 1)"""
)
def snk_timeline(spark, sf_dir):
    """SNK-3: entries that a timeline doesn't hold yet, each once."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("story"), F.col("role").alias("kind"), (F.col("turn") % 2).alias("occurred_at"), F.col("text").alias("headline"), F.col("conv_id").cast("string").alias("url"), "turn")
    log = feeds.append_timeline(rows.limit(0).withColumn("dedup_key", F.lit("")), rows.filter("turn <= 1"))
    return feeds.append_timeline(log, rows.filter("turn > 1")).select("story", "dedup_key")


@query("WITH s AS (SELECT DISTINCT c_mktsegment AS division, c_nationkey % 5 AS version FROM customer WHERE c_custkey % 2 = 0) SELECT DISTINCT c_mktsegment AS division, c_nationkey % 5 AS version FROM customer WHERE c_custkey % 7 <> 0 AND (c_mktsegment, c_nationkey % 5) NOT IN (SELECT * FROM s WHERE version <> 3)")
def snk_snapshot(spark, sf_dir):
    """SNK-4: rows whose key isn't stored; blank names don't count."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("division"), (F.col("c_nationkey") % 5).alias("version"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).otherwise(" ").alias("name"), "c_custkey")
    store = rows.filter("c_custkey % 2 = 0 and version <> 3")
    return feeds.append_snapshot(store, rows, ["division", "version"]).select("division", "version")


@query(
    """WITH o AS (SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN p_brand END AS brand, [p_type, 'x'] AS aliases FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_partkey AS k, p_name AS brand, ['a', p_type] AS aliases FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(o.k, n.k) AS entity, coalesce(o.brand, n.brand) AS brand, array_to_string(list_sort(list_distinct(list_concat(coalesce(o.aliases, []), coalesce(n.aliases, [])))), '|') AS aliases FROM o FULL JOIN n ON o.k = n.k"""
)
def snk_entities(spark, sf_dir):
    """SNK-6: gaps are filled, aliases united."""
    part = table(spark, sf_dir, "part")
    old = part.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("entity"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("brand"), F.array("p_type", F.lit("x")).alias("aliases"))
    new = part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("brand"), F.array(F.lit("a"), F.col("p_type")).alias("aliases"))
    return feeds.upsert_entities(old, new).select("entity", "brand", F.array_join("aliases", "|").alias("aliases"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE event_type <> 'error' OR day(ts) % 2 = 0 GROUP BY 1")
def snk_partitions(spark, sf_dir):
    """SNK-7: a table by day, of which every second day is then written anew."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.dayofmonth("ts") % 2 == 0).alias("even"))
    path = new_folder(spark)
    feeds.write_partitioned(rows.filter("event_type <> 'error'").drop("even"), path, ["day"])
    feeds.write_partitioned(rows.filter("even").drop("even"), path, ["day"])
    schema = "event_id long, event_type string, day string"
    return spark.read.schema(schema).parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT event_id, coalesce(try_cast(CASE WHEN event_id % 5 = 0 THEN NULL ELSE json_extract(props, '$.k') END AS BIGINT), -1) AS k FROM events")
def js_props(spark, sf_dir):
    """JS-1: every fifth value is broken, which gives the default."""
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.lit('{"k": [broken')).otherwise(F.col("props")).alias("props"))
    k = timefn.decode(F.col("props"), "k long", F.struct(F.lit(None).cast("long").alias("k")))["k"]
    return rows.select("event_id", F.coalesce(k, F.lit(-1)).alias("k"))
