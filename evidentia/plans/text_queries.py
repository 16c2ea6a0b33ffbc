"""Queries over texts, URLs and times (2.1 to 2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, timefn, url
from ..lexicons import STOPWORDS, TRACKING
from ..operators import classify, entities, feeds, matching
from ..sources import landing
from ..sources.scratch import keep
from .registry import constants, query, table

NORM = "trim(regexp_replace(regexp_replace(replace(lower(strip_accents({c})), '&', ' and '), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def norm(c: str) -> str:
    return NORM.format(c=c)


def toks(c: str) -> str:
    return f"list_filter(string_split({norm(c)}, ' '), lambda w: length(w) > 1 AND NOT list_contains({STOP}, w))"


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(f"SELECT doc_id, md5({norm('text')}) AS h, length({norm('text')})::BIGINT AS n FROM documents")
def str_normalize(spark, sf_dir):
    """STR-2 to 4"""
    n = text.normalize(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", n.alias("n_")).select("doc_id", F.md5(F.col("n_").cast("binary")).alias("h"), F.length("n_").cast("long").alias("n"))


@query(f"SELECT doc_id, len({toks('text')})::BIGINT AS n_tokens, len(list_distinct({toks('text')}))::BIGINT AS n_distinct FROM documents")
def str_tokens(spark, sf_dir):
    """STR-7"""
    t = documents(spark, sf_dir).select("doc_id", text.tokens(text.normalize(F.col("text"))).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(
    f"""WITH d AS (SELECT doc_id, list_distinct({toks('text')}) AS s FROM documents), p AS (SELECT a.doc_id, a.s AS x, b.s AS y FROM d a JOIN d b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6)::DOUBLE AS jaccard,
 round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / least(len(x), len(y)) END, 6)::DOUBLE AS overlap FROM p"""
)
def str_set_similarity(spark, sf_dir):
    """STR-13, 14: each document with the next."""
    # a text's words are found once, though it is compared with two
    d = keep(documents(spark, sf_dir).select("doc_id", text.token_set(text.normalize(F.col("text"))).alias("s")))
    p = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("s2")), "doc_id")
    found = p.select("doc_id", text.shares(F.col("s"), F.col("s2")).alias("x"))
    return found.select("doc_id", F.round("x.jaccard", 6).alias("jaccard"), F.round("x.overlap", 6).alias("overlap"))


@query(f"SELECT item_id, coalesce(nullif(regexp_replace(substr(replace({norm('text')}, ' ', '-'), 1, 80), '-+$', ''), ''), 'story') AS slug FROM benchmark")
def str_slug(spark, sf_dir):
    """STR-8"""
    return table(spark, sf_dir, "benchmark").select("item_id", text.slugify(F.col("text")).alias("slug"))


@query(
    """SELECT item_id, CASE WHEN length(text) > 120 THEN regexp_replace(regexp_replace(substr(text, 1, 117), ' [^ ]*$', ''), '[ ,.;:-]+$', '') || '...' ELSE text END AS short FROM benchmark"""
)
def str_truncate(spark, sf_dir):
    """STR-9"""
    return table(spark, sf_dir, "benchmark").select("item_id", text.truncate(F.col("text"), 120).alias("short"))


@query(
    f"""WITH u AS (SELECT page_id, url, regexp_replace(regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), ':[0-9]+$', ''), '^www\\.', '') AS host,
 regexp_replace(regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/$', '') AS path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM pages),
k AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda p: strpos(p, '=') > 0 AND length(p) > strpos(p, '=') AND NOT list_contains({TRACKING}, lower(split_part(p, '=', 1))))) AS kept FROM u),
c AS (SELECT page_id, host, 'https://' || host || path || CASE WHEN len(kept) > 0 THEN '?' || list_aggregate(kept, 'string_agg', '&') ELSE '' END AS canonical FROM k)
SELECT page_id, canonical, host AS domain, sha1(canonical) AS url_hash FROM c"""
)
def url_canonical(spark, sf_dir):
    """URL-1 to 3"""
    u = F.col("url")
    rows = table(spark, sf_dir, "pages").select("page_id", url.canonical_url(u).alias("canonical"), url.domain_of(u).alias("domain"))
    return rows.withColumn("url_hash", F.sha1("canonical"))


CLASSES = [("example.com", "MAJOR_NEWS", 0.85, "com"), ("example.net", "TRUSTED_REPORTER", 0.7, "net"), ("example.org", "UNKNOWN", 0.3, "org"), ("cheap-pills.example.com", "FAN_ACCOUNT", 0.15, "pills")]
CLASSES_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', {c}, '{d}')" for a, b, c, d in CLASSES) + ") c(id, classification, w, family)"


@query(
    f"""WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www\\.', '') AS domain FROM pages),
m AS (SELECT page_id, domain, classification, family, row_number() OVER (PARTITION BY page_id ORDER BY length(id) DESC) AS r FROM p LEFT JOIN {CLASSES_SQL} ON domain = id OR suffix(domain, '.' || id))
SELECT page_id, domain, classification, family AS independence_group FROM m WHERE r = 1"""
)
def join_domain_class(spark, sf_dir):
    """JOIN-1"""
    pages = table(spark, sf_dir, "pages").select("page_id", url.domain_of(F.col("url")).alias("domain"))
    classes = constants(spark, CLASSES, "normalized_id string, classification string, reliability_weight double, independence_group string")
    return entities.classify_domains(pages, classes).select("page_id", "domain", "classification", "independence_group")


@query(
    """SELECT event_id, round(date_diff('microsecond', ts, TIMESTAMP '2024-01-20 00:00:00') / 3.6e9, 4) AS age, ts > TIMESTAMP '2024-01-20 01:30:00' AS future,
 strftime(CASE WHEN ts > TIMESTAMP '2024-01-20 01:30:00' THEN TIMESTAMP '2024-01-20 00:00:00' ELSE ts END, '%Y-%m-%dT%H:%M:%SZ') AS clean FROM events"""
)
def dt_sanitise(spark, sf_dir):
    """DT-2 to 5"""
    at, now = F.col("ts").cast("timestamp"), F.lit("2024-01-20 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", F.round(timefn.age_hours(at, now), 4).alias("age"), timefn.is_future(at, now).alias("future"), timefn.to_iso(timefn.sanitise(at, now, now)).alias("clean"))


#: A lexicon of the documents' own words, in place of the sport's.
LEXICON = {"alpha": ["thation", "handnt"], "beta": ["ingthe", "onth", "ition"], "gamma": ["eau", "ment la"], "delta": ["sch", "ung der"]}


def _sql_score(title: str, body: str, terms: list[str]) -> str:
    hit = lambda c, t: f"contains(' ' || {c} || ' ', ' {t} ')" if len(t) <= 4 else f"contains({c}, '{t}')"
    return " + ".join(f"CASE WHEN {hit(title, t)} THEN 3 WHEN {hit(body, t)} THEN 1 ELSE 0 END" for t in terms)


@query(
    f"""WITH n AS (SELECT doc_id, {norm("split_part(text, chr(10), 1)")} AS t, {norm('text')} AS b FROM documents),
s AS (SELECT doc_id, t, {', '.join(f"{_sql_score('t', 'b', v)} AS {k}" for k, v in LEXICON.items())} FROM n), m AS (SELECT *, greatest(alpha, beta, gamma, delta) AS best FROM s)
SELECT doc_id, best::BIGINT AS best, CASE WHEN contains(t, 'thation') OR contains(t, 'handnt') THEN 'alpha' WHEN best = 0 THEN 'general' WHEN delta = best THEN 'delta' WHEN gamma = best THEN 'gamma' WHEN beta = best THEN 'beta' ELSE 'alpha' END AS category FROM m"""
)
def cls_category(spark, sf_dir):
    """CLS-1, 2: the first line is the headline, the whole text the body."""
    rows = documents(spark, sf_dir).select("doc_id", text.normalize(F.substring_index("text", "\n", 1)).alias("t"), text.normalize(F.col("text")).alias("b"))
    order = ["delta", "gamma", "beta", "alpha"]
    rows = classify.with_scores(rows, "t", "b", LEXICON, "c_")
    return rows.select("doc_id", F.greatest(*(F.col(f"c_{g}") for g in order)).cast("long").alias("best"), classify.pick("c_", order, F.col("t"), LEXICON, ["alpha"]).alias("category"))


@query(
    f"""WITH e AS (SELECT item_id AS entity, list_aggregate(string_split({norm('text')}, ' ')[1:3], 'string_agg', ' ') AS phrase FROM benchmark),
d AS (SELECT phrase, min(entity) AS entity FROM e WHERE length(phrase) >= 4 GROUP BY phrase), n AS (SELECT doc_id, ' ' || {norm('text')} || ' ' AS t FROM documents)
SELECT doc_id, count(DISTINCT entity) AS n_entities, min(entity) AS first_entity FROM n JOIN d ON contains(t, ' ' || phrase || ' ') GROUP BY doc_id"""
)
def ent_dictionary_match(spark, sf_dir):
    """ENT-1, 2: names are the first three words of the benchmark's passages."""
    names = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entity"), F.array_join(F.slice(F.split(text.normalize(F.col("text")), " "), 1, 3), " ").alias("name"), F.array().cast("array<string>").alias("aliases"))
    found = entities.find_entities(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), entities.build_dictionary(names).filter("not is_surname"), most=None)
    return found.select(F.col("id").alias("doc_id"), F.size("entities").cast("long").alias("n_entities"), F.array_min("entities").alias("first_entity"))


@query(
    f"""WITH w AS (SELECT item_id AS id, {toks('text')} AS w FROM benchmark), g AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram FROM w WHERE len(w) > 0),
tf AS (SELECT id, gram, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram), n AS (SELECT count(*) AS n FROM w WHERE len(w) > 0),
x AS (SELECT id, gram, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS r FROM tf JOIN df USING (gram), n), s AS (SELECT id, sqrt(sum(r * r)) AS norm FROM x GROUP BY id)
SELECT a.id AS a, b.id AS b, round(sum(a.r / sa.norm * b.r / sb.norm), 6) AS cosine FROM x a JOIN x b ON a.gram = b.gram AND a.id < b.id JOIN s sa ON sa.id = a.id JOIN s sb ON sb.id = b.id GROUP BY ALL HAVING sum(a.r / sa.norm * b.r / sb.norm) >= 0.05"""
)
def dup_tfidf_cosine(spark, sf_dir):
    """DUP-2 over the benchmark's passages."""
    w = keep(matching.tfidf(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")))
    pairs = matching.blocked_pairs(matching.prefix_keys(w, 0.05))
    return matching.cosine(pairs, w).filter("content >= 0.05").select("a", "b", F.round("content", 6).alias("cosine"))



@query(
    """SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS id FROM documents WHERE text ILIKE '%thation%' UNION ALL SELECT 'page', CAST(page_id AS VARCHAR) FROM pages WHERE url ILIKE '%thation%'
UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR) FROM part WHERE p_name ILIKE '%thation%'"""
)
def flt_search(spark, sf_dir):
    """FLT-5"""
    kinds = {"document": (documents(spark, sf_dir), "doc_id", "text"), "page": (table(spark, sf_dir, "pages"), "page_id", "url"), "part": (table(spark, sf_dir, "part"), "p_partkey", "p_name")}
    return feeds.search(kinds, "thation").drop("label")


@query(
    """WITH k AS (SELECT event_id AS id, ts, user_id AS e FROM events), s AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY ts DESC, id DESC) AS r FROM k),
p AS (SELECT k.id, s.id AS other, s.ts AS ots FROM k JOIN s ON k.e = s.e AND s.r <= 7 AND s.id <> k.id), q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ots DESC, other DESC) AS r FROM p)
SELECT id, count(*) AS n, sum(other)::BIGINT AS others FROM q WHERE r <= 6 GROUP BY id"""
)
def join_related(spark, sf_dir):
    """JOIN-9: events of the same user, the newest six."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.array(F.col("user_id")).alias("entities"))
    found = entities.related(rows)
    return found.select("id", F.size("related").cast("long").alias("n"), F.aggregate("related", F.lit(0).cast("long"), lambda a, x: a + x).alias("others"))


#: A short one, single words, and one of five words that a document holds.
TERMS = ["thation", "eau de", "the of", "schung", "the", "a"]


@query(f"WITH n AS (SELECT doc_id, ' ' || {norm('text')} || ' ' AS t FROM documents), w AS (SELECT unnest({TERMS}) AS term) SELECT doc_id AS id, count(*) AS hits FROM n JOIN w ON contains(t, ' ' || term || ' ') GROUP BY doc_id")
def join_watchlist(spark, sf_dir):
    """JOIN-11, SET-2"""
    terms = constants(spark, [(t,) for t in TERMS], "term string")
    return entities.watched(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), terms).select("id", F.col("hits").cast("long").alias("hits"))






@query(r"""SELECT doc_id, (len(regexp_extract_all(trim(regexp_replace(text, '\s+', ' ', 'g')), '[.!?]\s+[A-Z0-9"''“]')) + 1)::BIGINT AS n_sentences FROM documents""")
def str_sentences(spark, sf_dir):
    """STR-10"""
    return documents(spark, sf_dir).select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query(
    """WITH b AS (SELECT *, CASE source WHEN 'src1' THEN 'OFFICIAL' WHEN 'src2' THEN 'MAJOR_NEWS' WHEN 'src3' THEN 'FAN_ACCOUNT' END AS a_type, CASE source WHEN 'src1' THEN 1.0 WHEN 'src2' THEN 0.85 WHEN 'src3' THEN 0.15 END AS a_weight,
 CASE WHEN lang = 'en' THEN 'UNKNOWN' ELSE 'INSIDER' END AS st, CASE WHEN lang = 'en' THEN 0.3 ELSE 0.5 END AS w FROM documents)
SELECT doc_id, CASE WHEN a_weight > w AND st IN ('UNKNOWN', 'FAN_ACCOUNT') THEN a_type ELSE st END AS source_type, CASE WHEN a_weight > w THEN a_weight ELSE w END::DOUBLE AS reliability_weight FROM b"""
)
def join_author_class(spark, sf_dir):
    """JOIN-2: the source stands for the byline."""
    rows = documents(spark, sf_dir).select("doc_id", F.concat("source", F.lit(", staff")).alias("author"), F.when(F.col("lang") == "en", F.lit("UNKNOWN")).otherwise("INSIDER").alias("source_type"), F.when(F.col("lang") == "en", 0.3).otherwise(0.5).alias("reliability_weight"))
    authors = constants(spark, [("src1", "OFFICIAL", 1.0), ("src2", "MAJOR_NEWS", 0.85), ("src3", "FAN_ACCOUNT", 0.15)], "normalized_id string, classification string, reliability_weight double")
    return entities.upgrade_by_author(rows, authors).select("doc_id", "source_type", "reliability_weight")



@query(
    """WITH o AS (SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_partkey, p_type AS p_brand, p_size + 100 AS p_size FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, coalesce(o.p_brand, n.p_brand) AS p_brand, coalesce(n.p_size, o.p_size)::INTEGER AS p_size FROM o FULL JOIN n ON o.p_partkey = n.p_partkey"""
)
def snk_merge_dimension(spark, sf_dir):
    """SNK-5: brands are the user's and protected, sizes are not."""
    part = table(spark, sf_dir, "part")
    old = part.filter("p_partkey % 3 <> 0").select("p_partkey", "p_brand", "p_size")
    new = part.filter("p_partkey % 2 = 0").select("p_partkey", F.col("p_type").alias("p_brand"), (F.col("p_size") + 100).alias("p_size"))
    return feeds.merge_dimension(old, new, "p_partkey", ["p_brand"])


@query("WITH f AS (SELECT user_id, last(event_type ORDER BY ts, event_type) AS fixed FROM events GROUP BY user_id) SELECT c_custkey, coalesce(fixed, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN f ON c_custkey = user_id")
def res_overlay(spark, sf_dir):
    """RES-15: the latest correction of each customer's segment."""
    from ..operators.resolve import overlay

    fixes = table(spark, sf_dir, "events").select(F.col("user_id").alias("target"), F.col("event_type").alias("value"), F.col("ts").alias("at"))
    return overlay(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), fixes, "c_custkey", "c_mktsegment")


@query("SELECT system, count(*) AS n FROM (SELECT c_mktsegment || '|' || c_nationkey AS system FROM customer) GROUP BY system HAVING count(*) > 1")
def dq_duplicate_positions(spark, sf_dir):
    """DQ-9"""
    from ..operators.checks import duplicates

    found = duplicates(table(spark, sf_dir, "customer"), F.concat_ws("|", "c_mktsegment", "c_nationkey"), "ERROR", "duplicate_position")
    return found.select(F.col("row_key").alias("system"), F.col("detail").cast("long").alias("n"))
