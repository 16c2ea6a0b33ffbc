"""Queries over merged events and corrections (RES-2, 3, 15, JOIN-8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalize
from ..lexicons import PRIORITY
from ..operators import identity
from ..sources.scratch import keep
from .newsroom import chosen, person, person_sql
from .registry import query, table
from .shapes import pick
from .text_queries import norm

NAMES = ["UFC Fight Night: {}", "UFC Fight Night", "Gala {} vs. Costa", "Gala vs", "Noche UFC {}"]
ORIGINS = ["detected", "collected", "user", "official"]
CATEGORIES = [*PRIORITY, "general"]


def events(spark, sf_dir):
    """An event for every part: parts of a size, type and container's remainder are one event; every seventeenth was merged before."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part")
    name = F.replace(pick(k, NAMES), F.lit("{}"), pick(F.floor(k / 5), ["Silva", "Baker-Lee", "Duarte"]))
    return rows.select(
        k.alias("event"), F.concat_ws("|", (k % 97).cast("string"), (k % 3).cast("string")).alias("key"), name.alias("name"), pick(F.floor(k / 2), ORIGINS).alias("data_origin"), F.when(k % 17 == 0, k - 1).alias("merged_into"),
        F.when(k % 4 > 0, F.concat(F.lit("hall "), (k % 13).cast("string"))).alias("venue"), F.when(k % 6 == 0, F.concat(F.lit("u"), k.cast("string"))).alias("url"), F.col("p_size").cast("long").alias("mentions"), F.col("p_retailprice").alias("last_seen"),
    )


EVENTS = f"""ev AS (SELECT p_partkey AS event, (p_partkey % 97) || '|' || (p_partkey % 3) AS key, replace({chosen('p_partkey', NAMES)}, '{{}}', {chosen('p_partkey // 5', ['Silva', 'Baker-Lee', 'Duarte'])}) AS name,
 {chosen('p_partkey // 2', ORIGINS)} AS origin, CASE WHEN p_partkey % 17 = 0 THEN p_partkey - 1 END AS merged_into, CASE WHEN p_partkey % 4 > 0 THEN 'hall ' || (p_partkey % 13) END AS venue,
 CASE WHEN p_partkey % 6 = 0 THEN 'u' || p_partkey END AS url, p_size::BIGINT AS mentions, p_retailprice AS last_seen FROM part),
lv AS (SELECT *, CASE origin WHEN 'collected' THEN 3 WHEN 'official' THEN 3 WHEN 'user' THEN 2 ELSE 1 END AS trust, CASE WHEN regexp_matches(name, '[^ ]+ vs[.]? [^ ]') THEN 1 ELSE 0 END AS says FROM ev WHERE merged_into IS NULL),
rk AS (SELECT *, row_number() OVER w AS place, first(event) OVER w AS keeper FROM lv WINDOW w AS (PARTITION BY key ORDER BY trust DESC, says DESC, length(name) DESC, event))"""


def bouts(spark, sf_dir):
    k = F.col("o_orderkey")
    pair = F.array_join(F.array_sort(F.array(normalize(person(F.col("o_custkey"))), normalize(person(k)))), "|")
    n = table(spark, sf_dir, "part").count()
    return table(spark, sf_dir, "orders").select(k.alias("id"), (k % n).alias("event"), pair.alias("pair_key"), F.col("o_orderstatus").alias("status"))


BOUTS = f"bt AS (SELECT o_orderkey AS id, o_orderkey % (SELECT count(*) FROM part) AS event, array_to_string(list_sort([{norm(person_sql('o_custkey'))}, {norm(person_sql('o_orderkey'))}]), '|') AS pair_key, o_orderstatus AS status FROM orders)"
TARGETS = "SELECT event AS id, keeper AS target FROM rk WHERE event <> keeper UNION ALL SELECT event, merged_into FROM ev WHERE merged_into IS NOT NULL"


def merged(spark, sf_dir):
    rows = keep(events(spark, sf_dir))
    aliases = rows.select(F.explode(F.array(F.concat(F.lit("n:"), F.lower("name")), F.concat(F.lit("e:"), F.col("event").cast("string")))).alias("alias_key"), "event")
    return identity.merge_events(rows, bouts(spark, sf_dir), aliases, keep, ["venue", "url"], ["mentions"], ["last_seen"])


@query(
    f"""WITH {EVENTS} SELECT keeper AS event, first(key) AS key, first(name ORDER BY place) AS name, first(venue ORDER BY place) FILTER (venue IS NOT NULL) AS venue, first(url ORDER BY place) FILTER (url IS NOT NULL) AS url,
 sum(mentions)::BIGINT AS mentions, max(last_seen) AS last_seen, count(*) - 1 AS merged FROM rk GROUP BY keeper"""
)
def res_merged_events(spark, sf_dir):
    """RES-2: keepers with their gaps filled."""
    return merged(spark, sf_dir)["events"].drop("data_origin")


@query(
    f"""WITH {EVENTS}, {BOUTS}, m AS (SELECT bt.*, coalesce(keeper, bt.event) AS e, coalesce(keeper = bt.event, true) AS own, place FROM bt LEFT JOIN rk ON rk.event = bt.event),
r AS (SELECT *, row_number() OVER (PARTITION BY e, pair_key ORDER BY own DESC, place, id) AS r FROM m) SELECT id, e AS event, pair_key, status FROM r WHERE r = 1"""
)
def res_merged_bouts(spark, sf_dir):
    """RES-2: bouts at their keepers; of two for one pair the keeper's own stays."""
    return merged(spark, sf_dir)["bouts"]


@query(
    f"""WITH RECURSIVE {EVENTS}, l AS ({TARGETS}), w AS (SELECT id, target FROM l UNION SELECT w.id, l.target FROM w JOIN l ON l.id = w.target) SELECT id, target FROM w WHERE target NOT IN (SELECT id FROM l)"""
)
def res_redirects(spark, sf_dir):
    """RES-2: losers, and what was merged into them before, lead to the event that is left."""
    return merged(spark, sf_dir)["redirects"]


@query(
    f"""WITH {EVENTS}, a AS (SELECT unnest(['n:' || lower(name), 'e:' || event]) AS alias_key, event FROM ev), m AS (SELECT alias_key, coalesce(keeper, a.event) AS e, coalesce(keeper = a.event, true) AS own FROM a LEFT JOIN rk ON rk.event = a.event)
SELECT alias_key, first(e ORDER BY own DESC, e) AS event, bool_or(own AND e IN (SELECT event FROM ev WHERE merged_into IS NOT NULL)) AS was_tombstone FROM m GROUP BY alias_key"""
)
def res_merged_aliases(spark, sf_dir):
    """RES-2, JOIN-8: aliases at their keepers, and whether one of a merged event was among them."""
    found, rows = merged(spark, sf_dir)["aliases"], events(spark, sf_dir)
    aliases = rows.select(F.explode(F.array(F.concat(F.lit("n:"), F.lower("name")), F.concat(F.lit("e:"), F.col("event").cast("string")))).alias("alias_key"), "event")
    dead = rows.filter("merged_into is not null")
    live = identity.live_aliases(aliases, dead)
    buried = aliases.join(live, ["alias_key", "event"], "left_anti").select("alias_key").distinct().withColumn("was_tombstone", F.lit(True))
    return found.join(buried, "alias_key", "left").select("alias_key", "event", F.coalesce("was_tombstone", F.lit(False)).alias("was_tombstone"))


@query(
    f"""WITH {EVENTS}, r AS (SELECT key, name, row_number() OVER (PARTITION BY key ORDER BY trust DESC, says DESC, length(name) DESC, name DESC) AS r FROM lv) SELECT key, name FROM r WHERE r = 1"""
)
def res_display_names(spark, sf_dir):
    """RES-3: the better display name."""
    return identity.better_name(events(spark, sf_dir).filter("merged_into is null"), "key")


KINDS = ["reassign_event", "recategorise", "reclassify", "detach"]
LABELS = [*CATEGORIES, "nonsense"]
SPELLED = ["Official", "fan account", "trusted journalist"]


def corrected(spark, sf_dir):
    o, l, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "supplier"))
    k, n, q = F.col("l_orderkey"), F.col("l_linenumber").cast("long"), F.col("l_partkey")
    stories = o.select(F.col("o_orderkey").alias("story"), F.col("o_custkey").alias("event"), pick(F.col("o_orderkey"), CATEGORIES).alias("category"))
    sources = p.select(F.col("s_suppkey").alias("source"), F.lit("UNKNOWN").alias("source_type"), F.lit(0.3).alias("reliability"))
    links = l.select(k.alias("story"), q.alias("article")).distinct()
    kind = pick(n, KINDS)
    some = l.filter((k % 5 == 0) | (n % 4 == 2))
    value = (
        F.when(kind == "reassign_event", F.when(q % 5 > 0, (q % 40).cast("string")))
        .when(kind == "recategorise", pick(q, LABELS))
        .when(kind == "reclassify", pick(q, SPELLED))
        .otherwise(F.when(q % 2 == 0, q.cast("string")).otherwise("-1"))
    )
    target = F.when(kind == "reclassify", F.col("l_suppkey")).otherwise(F.when(q % 11 == 0, -k).otherwise(k))
    weight = F.when(q % 3 > 0, (q % 30) / 10 - 1)
    made = some.select((k * 8 + n).alias("id"), F.when(q % 23 == 0, F.lit("praise")).otherwise(kind).alias("kind"), target.alias("target"), value.alias("value"), weight.alias("weight"), F.lit("seen").alias("reason"), F.col("l_shipdate").alias("at"))
    return identity.apply_corrections(stories, sources, links, made, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("event")), CATEGORIES)


MADE = f"""md AS (SELECT l_orderkey * 8 + l_linenumber AS id, {chosen('l_linenumber', KINDS)} AS kd, l_partkey AS q, l_orderkey AS k, l_suppkey AS sk, l_shipdate AS t0 FROM lineitem WHERE l_orderkey % 5 = 0 OR l_linenumber % 4 = 2),
cr AS (SELECT id, CASE WHEN q % 23 = 0 THEN 'praise' ELSE kd END AS kind, CASE WHEN kd = 'reclassify' THEN sk WHEN q % 11 = 0 THEN -k ELSE k END AS target,
 CASE kd WHEN 'reassign_event' THEN CASE WHEN q % 5 > 0 THEN CAST(q % 40 AS VARCHAR) END WHEN 'recategorise' THEN {chosen('q', LABELS)} WHEN 'reclassify' THEN {chosen('q', ['OFFICIAL', 'FAN_ACCOUNT', 'ESTABLISHED_JOURNALIST'])}
  ELSE CASE WHEN q % 2 = 0 THEN CAST(q AS VARCHAR) ELSE '-1' END END AS value, CASE WHEN q % 3 > 0 THEN greatest(0.0, least(1.0, ((q % 30)::DOUBLE / 10 - 1)))::DOUBLE END AS weight, t0 FROM md),
st AS (SELECT o_orderkey AS story, o_custkey AS event, {chosen('o_orderkey', CATEGORIES)} AS category FROM orders),
ck AS (SELECT cr.*, CASE WHEN kind = 'praise' THEN 'no such kind' WHEN kind = 'detach' THEN CASE WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = target AND CAST(l_partkey AS VARCHAR) = value) THEN 'no such link' END
  WHEN kind = 'reclassify' THEN CASE WHEN target NOT IN (SELECT s_suppkey FROM supplier) THEN 'no such target' END WHEN target NOT IN (SELECT story FROM st) THEN 'no such target'
  WHEN kind = 'recategorise' THEN CASE WHEN value NOT IN ({', '.join(repr(c) for c in CATEGORIES)}) THEN 'no such category' END
  WHEN value IS NOT NULL AND try_cast(value AS BIGINT) NOT IN (SELECT c_custkey FROM customer) THEN 'no such event' END AS error FROM cr),
c2 AS (SELECT *, row_number() OVER (PARTITION BY kind, target, value ORDER BY t0, id) AS again FROM ck WHERE error IS NULL),
ok AS (SELECT * FROM c2 WHERE kind <> 'detach' OR again = 1)"""


@query(
    f"""WITH {MADE}, e AS (SELECT target, last(value ORDER BY t0, id) AS v FROM (SELECT target, coalesce(value, '-') AS value, t0, id FROM ok WHERE kind = 'reassign_event') GROUP BY target), c AS (SELECT target, last(value ORDER BY t0, id) AS v FROM ok WHERE kind = 'recategorise' GROUP BY target)
SELECT story, coalesce(CASE WHEN e.v IS NULL THEN event ELSE try_cast(e.v AS BIGINT) END, -1) AS event, coalesce(c.v, category) AS category FROM st LEFT JOIN e ON e.target = story LEFT JOIN c ON c.target = story"""
)
def res_corrected_stories(spark, sf_dir):
    """RES-15: stories' events and categories after all corrections; -1 where a story has no event any more."""
    return corrected(spark, sf_dir)["stories"].withColumn("event", F.coalesce("event", F.lit(-1)))


@query(
    f"""WITH {MADE}, t AS (SELECT target, last(value ORDER BY t0, id) AS v, last(weight ORDER BY t0, id) FILTER (weight IS NOT NULL) AS w FROM ok WHERE kind = 'reclassify' GROUP BY target)
SELECT s_suppkey AS source, coalesce(v, 'UNKNOWN') AS source_type, coalesce(w, 0.3)::DOUBLE AS reliability FROM supplier LEFT JOIN t ON target = s_suppkey"""
)
def res_corrected_sources(spark, sf_dir):
    """RES-15: types as they are spelled here, reliabilities between 0 and 1."""
    return corrected(spark, sf_dir)["sources"]


@query(
    f"""WITH {MADE}, a AS (SELECT id, kind, target, CASE kind WHEN 'detach' THEN value WHEN 'reassign_event' THEN CASE WHEN row_number() OVER w = 1 THEN CAST(event AS VARCHAR) ELSE lag(value) OVER w END
  WHEN 'recategorise' THEN coalesce(lag(value) OVER w, category) END AS before, CASE WHEN kind <> 'detach' THEN value END AS after FROM ok LEFT JOIN st ON story = target WHERE kind <> 'reclassify' WINDOW w AS (PARTITION BY kind, target ORDER BY t0, id))
SELECT id, kind, target, coalesce(before, '-') AS before, coalesce(after, '-') AS after FROM a"""
)
def res_correction_audit(spark, sf_dir):
    """RES-15: what each correction of a story found and left."""
    found = corrected(spark, sf_dir)["audit"].filter("kind <> 'reclassify'")
    return found.select("id", "kind", "target", F.coalesce("before", F.lit("-")).alias("before"), F.coalesce("after", F.lit("-")).alias("after"))


@query(f"WITH {MADE} SELECT id, kind, target, error FROM ck WHERE error IS NOT NULL UNION ALL SELECT id, kind, target, 'no such link' FROM c2 WHERE kind = 'detach' AND again > 1")
def res_rejected_corrections(spark, sf_dir):
    """RES-15: corrections that change nothing, and why."""
    return corrected(spark, sf_dir)["rejected"]


@query(f"WITH {MADE} SELECT DISTINCT l_orderkey AS story, l_partkey AS article FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM ok WHERE kind = 'detach' AND target = l_orderkey AND value = CAST(l_partkey AS VARCHAR))")
def res_detached_links(spark, sf_dir):
    """RES-15: links that are left."""
    return corrected(spark, sf_dir)["links"]
