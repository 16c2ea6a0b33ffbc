"""Queries over who and what articles name, events, bouts and story clusters (2.6 to 2.8, 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import cards, classify, entities, matching, resolve
from ..sources.scratch import keep
from . import newsroom
from .news_queries import ENRICHED, any_in, cleaned, enriched, hit, title_sql
from .newsroom import ARTICLES, FIRST, LAST, chosen, listed, person, person_sql
from .registry import constants, query, table
from .shapes import pick
from .text_queries import STOP, norm, toks

GALAS = [(1, "Main Card Gala", "main card"), (2, "Gym Open", "the gym"), (3, "UFC 312", "ufc")]


def every(c: str, pattern: str, made: str) -> str:
    return f"list_transform(regexp_extract_all({c}, '{pattern}', 1), lambda x: {made})"


@query(
    f"""WITH {ARTICLES}, t AS (SELECT id, title || ' ' || body AS text FROM art), n AS (SELECT *, ' ' || {norm('text')} || ' ' AS w FROM t),
p AS (SELECT id, list_concat({every('text', chr(40) + '?i)\\bufc\\s*(\\d{2,4})\\b', "'UFC ' || x")}, CASE WHEN regexp_matches(text, '(?i)\\bnoche\\s+ufc\\b') THEN ['Noche UFC'] ELSE [] END, CASE WHEN regexp_matches(text, '(?i)\\bufc\\s+fight\\s+night\\b') THEN ['UFC Fight Night'] ELSE [] END,
  {every('text', chr(40) + '?i)\\bufc\\s+vegas\\s+(\\d{1,3})\\b', "'UFC Vegas ' || x")},
  list_transform(list_sort(list_filter([{{'at': instr(w, ' main card '), 'n': 'Main Card Gala'}}, {{'at': instr(w, ' the gym '), 'n': 'Gym Open'}}, {{'at': instr(w, ' ufc 312 '), 'n': 'UFC 312'}}], lambda x: x['at'] > 0)), lambda x: x['n'])) AS names FROM n)
SELECT id, array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i)[1:4], '|') AS events FROM p"""
)
def ent_events(spark, sf_dir):
    """ENT-3: by pattern, then by the events that are known."""
    texts = newsroom.articles(spark, sf_dir).select("id", F.concat_ws(" ", "title", "body").alias("text"))
    known = constants(spark, GALAS, "event long, name string, short_name string")
    return entities.event_mentions(texts, known).select("id", F.array_join("events", "|").alias("events"))


AMBIGUOUS = ["jones"]
KNOWN_SQL = f"kn AS (SELECT i AS entity, {person_sql('i')} AS name FROM range({len(LAST)}) r(i)), kw AS (SELECT *, {norm('name')} AS whole, string_split({norm('name')}, ' ')[-1] AS last FROM kn)"
NAMES = text.run_of(text.NAME_PART, 4)
VERSUS = rf"({NAMES})\s+(?:vs\.?|versus)\s+({NAMES})".replace("'", "''")


def side_sql(c: str) -> str:
    """A side of a matchup as the dictionary calls it: whole, by surname, by its last words, else as written."""
    w = f"string_split({norm(c)}, ' ')"
    written = f"array_to_string(list_transform(string_split(trim({c}, ' .,:;-'), ' '), lambda p: upper(p[1]) || lower(p[2:])), ' ')"
    return f"""coalesce((SELECT min(name) FROM kw WHERE whole = {norm(c)}), (SELECT min(name) FROM kw WHERE last = {w}[-1] AND length(last) >= 5 AND last NOT IN ({', '.join(map(newsroom.text, AMBIGUOUS))})),
 (SELECT min(name) FROM kw WHERE suffix({norm(c)}, ' ' || whole)), CASE WHEN len({w}) BETWEEN 2 AND 4 AND len(list_filter({w}, lambda x: length(x) < 2)) = 0 THEN {written} END)"""


@query(
    f"""WITH {ARTICLES}, {KNOWN_SQL}, m AS (SELECT id, regexp_extract(title, '{VERSUS}', 1) AS x, regexp_extract(title, '{VERSUS}', 2) AS y FROM art WHERE regexp_matches(title, '{VERSUS}')),
u AS (SELECT DISTINCT x AS raw FROM m UNION SELECT DISTINCT y FROM m), n AS (SELECT raw, {side_sql('raw')} AS name, CASE WHEN string_split({norm('raw')}, ' ')[-1] = 'jones' THEN (SELECT name FROM kw WHERE last = 'jones') END AS loose FROM u),
r AS (SELECT id, coalesce(a.name, CASE WHEN b.name IS NOT NULL THEN a.loose END) AS p, coalesce(b.name, CASE WHEN a.name IS NOT NULL THEN b.loose END) AS q FROM m JOIN n a ON a.raw = x JOIN n b ON b.raw = y)
SELECT id, p || ' vs. ' || q AS matchups FROM r WHERE {norm('p')} <> {norm('q')}"""
)
def ent_matchups(spark, sf_dir):
    """ENT-1, 4: who meets whom, by the names that are known."""
    known = newsroom.known(spark).withColumn("entity", F.col("name"))
    texts = newsroom.articles(spark, sf_dir).select("id", F.col("title").alias("text"))
    found = entities.matchups(texts, entities.build_dictionary(known, AMBIGUOUS), entities.ambiguous_surnames(known, AMBIGUOUS))
    return found.select("id", F.array_join("matchups", "|").alias("matchups"))


@query(
    f"""WITH {ARTICLES}, {KNOWN_SQL}, t AS (SELECT id, ' ' || {norm("title || ' ' || body")} || ' ' AS w FROM art),
h AS (SELECT id, entity, CASE WHEN contains(w, ' ' || whole || ' ') THEN len(string_split(w[1:instr(w, ' ' || whole || ' ')], ' ')) WHEN length(last) >= 5 AND last <> 'jones' AND contains(w, ' ' || last || ' ') THEN len(string_split(w[1:instr(w, ' ' || last || ' ')], ' ')) END AS pos FROM t, kw)
SELECT id, string_agg(entity, '|' ORDER BY pos, entity) AS entities FROM h WHERE pos IS NOT NULL GROUP BY id"""
)
def ent_people(spark, sf_dir):
    """ENT-1, 2: known people by name, and by surname where the name isn't there."""
    texts = newsroom.articles(spark, sf_dir).select("id", F.concat_ws(" ", "title", "body").alias("text"))
    found = entities.find_entities(texts, entities.build_dictionary(newsroom.known(spark), AMBIGUOUS))
    return found.select("id", F.array_join(F.transform("entities", lambda e: e.cast("string")), "|").alias("entities"))


NO_NAMES = ["report", "rankings", "bout", "quiet"]


@query(
    f"""WITH {ARTICLES}, t AS (SELECT id, array_to_string(string_split(title, ' ')[1:3], ' ') AS start, {norm('body')} AS w FROM art), n AS (SELECT *, string_split({norm('start')}, ' ') AS ws FROM t)
SELECT id, len(ws) BETWEEN 2 AND 4 AND NOT list_has_any(ws, {listed(NO_NAMES)}) AS person, array_to_string(list_filter({listed(entities.WEIGHT_CLASSES)}, lambda c: contains(w, replace(c, '-', ' '))), '|') AS weights FROM n"""
)
def ent_plausible(spark, sf_dir):
    """ENT-5, 6"""
    start = F.array_join(F.slice(F.split("title", " "), 1, 3), " ")
    return newsroom.articles(spark, sf_dir).select("id", entities.looks_like_person(start, NO_NAMES).alias("person"), F.array_join(entities.weight_classes(text.normalize(F.col("body"))), "|").alias("weights"))


@query(
    """WITH m AS (SELECT p_partkey AS entity, p_partkey - p_partkey % 4 AS k, p_name || p_partkey AS name, [p_brand] AS aliases, p_size AS n, p_partkey % 4 > 0 AS lost FROM part)
SELECT k AS entity, max(name) FILTER (NOT lost) AS name, sum(n)::BIGINT AS mentions, array_to_string(list_sort(list_distinct(list_concat(flatten(list(aliases)), coalesce(list(name) FILTER (lost), [])))), '|') AS aliases FROM m GROUP BY k"""
)
def ent_merge(spark, sf_dir):
    """ENT-8: parts merged by fours into the first of them."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    rows = part.select(k.alias("entity"), F.concat("p_name", k).alias("name"), F.array("p_brand").alias("aliases"), F.col("p_size").cast("long").alias("mentions"), F.current_timestamp().alias("last_mentioned"))
    merges = part.filter(k % 4 > 0).select(k.alias("loser"), (k - k % 4).alias("keeper"))
    found = entities.merge_entity_rows(rows, merges)
    # and what refers to them is pointed anew: as many references as mentions
    moved = entities.merge_entities(rows.select("entity", "mentions"), merges).groupBy("entity").agg(F.sum("mentions").alias("mentions"))
    return found.drop("mentions").join(moved, "entity").select("entity", "name", "mentions", F.array_join("aliases", "|").alias("aliases"))


@query("SELECT 'all' AS listing, l_orderkey AS story, l_linenumber AS n, p_name FROM lineitem JOIN part ON l_partkey = p_partkey UNION ALL SELECT 'related', l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber > 1")
def join_story_items(spark, sf_dir):
    """JOIN-4: a story's parts; all but the origin are its related reports."""
    members = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("story"), F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("n"), F.when(F.col("l_linenumber") == 1, F.lit("origin")).otherwise("corroboration").alias("role"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name")
    found = lambda name, skip: entities.story_items(members, part, skip_primary=skip).select(F.lit(name).alias("listing"), "story", "n", "p_name")
    return found("all", False).unionByName(found("related", True))


NATION_HEADS = f"{chosen('k', [h[0] for h in newsroom.HEADLINES])} || {person_sql('k')} || {chosen('k', [h[1] for h in newsroom.HEADLINES])} || {person_sql('k + 5')} || {chosen('k', [h[2] for h in newsroom.HEADLINES])}"
WORDS = f"list_distinct({toks('x')})"


@query(
    f"""WITH {ARTICLES}, p AS (SELECT id AS post, t0, CASE WHEN id % 3 > 0 THEN [a, b] ELSE [] END AS pe, CASE WHEN id % 4 = 0 THEN ['UFC 312'] ELSE [] END AS pv, title AS x FROM art),
s AS (SELECT id AS story, t0 + INTERVAL 7 HOURS AS t1, CASE WHEN id % 3 <> 1 THEN [a, b] ELSE [] END AS se, CASE WHEN id % 8 = 0 THEN ['ufc  312'] ELSE [] END AS sv, title AS head FROM art WHERE id % 2 = 0),
p2 AS (SELECT *, {WORDS} AS pt, list_distinct(list_transform(pe, lambda e: {norm('e')})) AS pn FROM p),
s2 AS (SELECT *, {WORDS} AS st, list_distinct(list_transform(se, lambda e: {norm('e')})) AS sn FROM (SELECT *, head || CASE WHEN len(se) > 0 THEN ' ' || array_to_string(se, ' ') ELSE '' END AS x FROM s)),
c AS (SELECT post, story, pn, sn, CASE WHEN len(pn) = 0 OR len(sn) = 0 THEN 0 ELSE len(list_intersect(pn, sn)) / least(len(pn), len(sn)) END AS people,
  CASE WHEN len(pv) = 0 OR len(sv) = 0 THEN 0 ELSE 1 END AS event, len(list_intersect(pt, st)) AS shared, len(list_distinct(list_concat(pt, st))) AS either, len(pn) + len(sn) + len(pv) + len(sv) > 0 AS named
  FROM p2 JOIN s2 ON t1 BETWEEN t0 - INTERVAL 72 HOURS AND t0 + INTERVAL 48 HOURS),
d AS (SELECT *, CASE WHEN named THEN 0.45::DOUBLE * people + 0.25::DOUBLE * event + 0.30::DOUBLE * (shared / greatest(either, 1)) ELSE 0.85::DOUBLE * (shared / greatest(either, 1)) END AS score
  FROM c WHERE NOT (len(pn) > 0 AND len(sn) > 0 AND people = 0) AND NOT (people = 0 AND event = 0 AND shared < 3)),
r AS (SELECT *, row_number() OVER (PARTITION BY post ORDER BY round(score, 9) DESC, story) AS r FROM d WHERE score >= 0.34)
SELECT post, story, round(score, 6)::DOUBLE AS score FROM r WHERE r = 1"""
)
def join_post_stories(spark, sf_dir):
    """JOIN-7, WIN-1: every article as a post, linked to the stories of its days; every second article is a story."""
    none, k = F.array().cast("array<string>"), F.col("id")
    rows = newsroom.articles(spark, sf_dir)
    posts = rows.select(k.alias("post"), "at", F.col("title").alias("text"), F.when(k % 3 > 0, F.array("a", "b")).otherwise(none).alias("entities"), F.when(k % 4 == 0, F.array(F.lit("UFC 312"))).otherwise(none).alias("events"))
    stories = rows.filter(k % 2 == 0).select(
        k.alias("story"), (F.col("at") + F.make_dt_interval(hours=F.lit(7))).alias("last_seen"), F.col("title").alias("headline"),
        F.when(k % 3 != 1, F.array("a", "b")).otherwise(none).alias("entities"), F.when(k % 8 == 0, F.array(F.lit("ufc  312"))).otherwise(none).alias("events"),
    )
    return matching.link_posts(posts, stories).select("post", "story", F.round("score", 6).alias("score"))


EVENT_NAMES = ["UFC 312", "Crypto.com UFC 312", "UFC Fight Night: Silva vs Costa 2", "ufc  fight night - Costa vs. Silva presented by Acme", "Gala Night", "UFC on ESPN", "", "UFC 2024"]
EVENT_URLS = ["", "https://www.ufc.com/event/ufc-312", "https://www.ufc.com/event/UFC-fight-night-october-31-2026", "https://x.org/event/gala"]
SPONSORED = resolve.sponsor_pattern().replace("'", "''")
MONTH_SQL = "|".join(resolve.MONTHS)
VERSUS_KEY = "(?i)([^ ]+) vs[.]? ([^ ]+)(?: ([0-9])(?: |$))?"
KEYS_SQL = f"""k0 AS (SELECT p_partkey AS id, {chosen('p_partkey', EVENT_NAMES)} AS name, {chosen(f'p_partkey // {len(EVENT_NAMES)}', EVENT_URLS)} AS url, CASE WHEN p_partkey % 3 > 0 THEN '2026-01-0' || (p_partkey % 7 + 1) END AS day, CASE WHEN p_partkey % 50 = 0 THEN 'E' || (p_partkey % 4) END AS official FROM part),
k1 AS (SELECT *, trim(trim(regexp_replace(regexp_replace(regexp_replace(name, '{SPONSORED}', ' ', 'g'), '(?i)\\bpresented\\s+by\\b.*$', ' '), '\\s+', ' ', 'g')), ' :-') AS bare, nullif(lower(regexp_extract(url, '(?i)/event/([a-z0-9-]+)', 1)), '') AS slug FROM k0),
k2 AS (SELECT *, coalesce(CASE WHEN try_cast(nullif(regexp_extract({norm('bare')}, '(?:^| )ufc ?([0-9]{{2,4}})(?: |$)', 1), '') AS INTEGER) BETWEEN 1 AND 999 THEN regexp_extract({norm('bare')}, '(?:^| )ufc ?([0-9]{{2,4}})(?: |$)', 1) END, nullif(regexp_extract(slug, '^ufc-(\\d{{2,4}})$', 1), '')) AS number,
 regexp_matches(bare, '(?i)\\bufc\\s+(?:fight\\s+night|on\\s+(?:espn|abc|fox|fx))\\b') OR coalesce(starts_with(slug, 'ufc-fight-night'), false) AS night, {norm('bare')} AS plain FROM k1),
k3 AS (SELECT *, number IS NULL AND night AS dated, CASE WHEN regexp_matches(slug, '({MONTH_SQL})-(\\d{{1,2}})-(\\d{{4}})') THEN '2026-10-31' ELSE day END AS shown FROM k2),
ks AS (SELECT id, list_filter([CASE WHEN official IS NOT NULL THEN 'id:' || lower(official) END, 'number:' || number, CASE WHEN dated THEN 'night:' || shown END,
 CASE WHEN dated AND regexp_matches(bare, '{VERSUS_KEY}') THEN 'matchup:' || array_to_string(list_sort([{norm(f"regexp_extract(bare, '{VERSUS_KEY}', 1)")}, {norm(f"regexp_extract(bare, '{VERSUS_KEY}', 2)")}]), '-vs-') || CASE WHEN regexp_extract(bare, '{VERSUS_KEY}', 3) <> '' THEN '-' || regexp_extract(bare, '{VERSUS_KEY}', 3) ELSE '' END END,
 CASE WHEN number IS NULL THEN 'slug:' || slug END, 'name:' || CASE WHEN plain = '' THEN 'unknown' ELSE plain END], lambda x: x IS NOT NULL) AS keys FROM k3)"""


def keyed_events(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), pick(k, EVENT_NAMES).alias("name"), pick(F.floor(k / len(EVENT_NAMES)), EVENT_URLS).alias("url"), F.when(k % 3 > 0, F.concat(F.lit("2026-01-0"), k % 7 + 1)).cast("date").alias("day"), F.when(k % 50 == 0, F.concat(F.lit("E"), k % 4)).alias("official"))
    return rows.select("id", resolve.canonical_keys(F.col("name"), F.col("day"), F.col("url"), F.col("official")).alias("keys"))


@query(f"WITH {KEYS_SQL} SELECT id, array_to_string(keys, ' > ') AS keys FROM ks")
def res_event_keys(spark, sf_dir):
    """RES-1"""
    return keyed_events(spark, sf_dir).select("id", F.array_join("keys", " > ").alias("keys"))


ALIASES = [("number:312", "e312"), ("name:gala night", "gala"), ("night:2026-01-02", "second"), ("slug:gala", "gala page")]
ALIAS_SQL = "al(k, event) AS (VALUES " + ", ".join(f"('{k}', '{e}')" for k, e in ALIASES) + ")"


@query(
    f"""WITH {KEYS_SQL}, {ALIAS_SQL}, p AS (SELECT id, keys, unnest(keys) AS k, generate_subscripts(keys, 1) AS i FROM ks), h AS (SELECT id, first(event ORDER BY i, event) AS known FROM p JOIN al USING (k) GROUP BY id),
r AS (SELECT ks.id, keys, coalesce(known, sha1(keys[1])) AS event, known IS NULL AS is_new FROM ks LEFT JOIN h USING (id)), f AS (SELECT k, first(event ORDER BY id, event) AS event FROM (SELECT id, event, unnest(keys) AS k FROM r) GROUP BY k)
SELECT 'event' AS kind, CAST(id AS VARCHAR) AS k, event, is_new FROM r UNION ALL SELECT 'alias', coalesce(al.k, f.k), coalesce(al.event, f.event), al.k IS NULL FROM f FULL JOIN al ON al.k = f.k"""
)
def join_event_identity(spark, sf_dir):
    """JOIN-8: events by their strongest known key, and the aliases that they add."""
    rows, aliases = keyed_events(spark, sf_dir), constants(spark, ALIASES, "alias_key string, event string")
    found = resolve.resolve_identity(rows, aliases)
    more = resolve.register_aliases(rows, found, aliases).join(aliases.select("alias_key", F.lit(False).alias("is_new")), "alias_key", "left")
    return found.select(F.lit("event").alias("kind"), F.col("id").cast("string").alias("k"), "event", "is_new").unionByName(more.select(F.lit("alias").alias("kind"), F.col("alias_key").alias("k"), "event", F.coalesce("is_new", F.lit(True)).alias("is_new")))


@query(f"WITH {ARTICLES} SELECT id AS story, CASE WHEN id % 3 = 0 THEN 'e312' ELSE sha1('name:gala ' || (id % 5)) END AS event, id % 3 > 0 AS is_new FROM art WHERE id % 4 > 0")
def join_story_event(spark, sf_dir):
    """JOIN-10: stories' first events; every fourth names none."""
    k = F.col("id")
    names = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 3 == 0, F.array(F.lit("Crypto.com UFC 312"), F.lit("Other"))).otherwise(F.array(F.concat(F.lit("Gala "), k % 5)))
    stories = newsroom.articles(spark, sf_dir).select(k.alias("story"), names.alias("events"))
    return resolve.event_of_stories(stories, constants(spark, ALIASES, "alias_key string, event string"))


BOUTS = f"bo AS (SELECT o_orderkey AS id, o_custkey AS event, array_to_string(list_sort([{norm(person_sql('o_custkey'))}, {norm(person_sql('o_custkey * 3 + o_orderkey'))}]), '|') AS pair_key, {chosen('o_orderkey', ['main_event', 'co_main', 'main_card', 'prelims', 'other'])} AS segment, CASE WHEN o_orderkey % 6 > 0 THEN o_orderkey % 6 END AS bout_order, {chosen('o_orderkey // 2', ['scheduled', 'cancelled'])} AS status, {chosen('o_orderkey // 3', resolve.EVIDENCE)} AS level FROM orders)"


def bouts(spark, sf_dir):
    """A bout for every order, on the card of its customer."""
    k = F.col("o_orderkey")
    pair = F.array_join(F.array_sort(F.array(text.normalize(person(F.col("o_custkey"))), text.normalize(person(F.col("o_custkey") * 3 + k)))), "|")
    level = pick(F.floor(k / 3), resolve.EVIDENCE)
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("event"), pair.alias("pair_key"), pick(k, ["main_event", "co_main", "main_card", "prelims", "other"]).alias("segment"), F.when(k % 6 > 0, k % 6).alias("bout_order"),
        pick(F.floor(k / 2), ["scheduled", "cancelled"]).alias("status"), level.alias("evidence_level"), F.when(level == "official_card", F.lit("official")).otherwise("unofficial").alias("official_status"),
    )


@query(
    f"""WITH {BOUTS} SELECT id, (row_number() OVER (PARTITION BY event ORDER BY coalesce(nullif(list_position(['main_event', 'co_main', 'main_card', 'prelims'], segment), 0), 5), bout_order ASC NULLS LAST, id))::INTEGER AS place,
 CASE WHEN status = 'cancelled' THEN 'cancelled' WHEN level = 'official_card' THEN 'official' WHEN level IN ('report', 'major_report') THEN 'reported' ELSE 'rumoured' END AS bucket FROM bo"""
)
def win_card_order(spark, sf_dir):
    """WIN-5"""
    return resolve.card_order(bouts(spark, sf_dir)).select("id", "place", "bucket")


@query(f"WITH {BOUTS}, {KNOWN_SQL} SELECT name, count(*) AS bouts, count(DISTINCT event) AS cards FROM bo JOIN kw ON list_contains(string_split(pair_key, '|'), whole) GROUP BY name")
def join_bouts_of(spark, sf_dir):
    """JOIN-12: the bouts of every known person, on all cards."""
    found = entities.bouts_of(bouts(spark, sf_dir), newsroom.known(spark).select("name"))
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("bouts"), F.count_distinct("event").alias("cards"))


MEET = ["replaces", "steps in for", "will replace", "takes the place of", "met"]
SAYS = "Bruno Adams " + "{v}" + " Carla Costa"
CHANGED = f"""ch AS (SELECT id, a, b, title || '. ' || body || CASE WHEN id % 3 = 0 THEN ' Today ' || split_part(a, ' ', 2) || ' ' || {chosen('id // 3', MEET)} || ' ' || split_part(b, ' ', 2) || '.' ELSE '' END AS raw, category, CASE WHEN id % 5 > 0 THEN a END AS who FROM enriched),
cn AS (SELECT *, {norm('raw')} AS n, nullif(rtrim(regexp_extract(raw, '{{said}}', 1), '.'), '') AS comes, nullif(rtrim(regexp_extract(raw, '{{said}}', 2), '.'), '') AS goes FROM ch)"""
_NAME = text.run_of(text.CAPITALISED, 3).replace("'", "''")
SAID = rf"({_NAME})\s+(?:will\s+)?(?:{'|'.join(v.replace(' ', chr(92) + 's+') for v in cards.STEPPING_IN)})\s+({_NAME})"


def first_of(c: str, groups: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(hit(c, t) for t in terms)} THEN '{name}'" for name, terms in groups.items()) + " END"


PAIRS_SQL = f"list_transform(list_zip(regexp_extract_all(raw, '{VERSUS}', 1), regexp_extract_all(raw, '{VERSUS}', 2)), lambda p: array_to_string(list_sort([{norm('p[1]')}, {norm('p[2]')}]), '|'))"


@query(
    f"""WITH {ENRICHED}, {CHANGED.replace("{said}", SAID)}, cp AS (SELECT *, {PAIRS_SQL} AS ps, {first_of('n', cards.REASONS)} AS why, {first_of('n', cards.SEGMENTS)} AS segment, list_filter({listed(entities.WEIGHT_CLASSES)}, lambda c: contains(n, replace(c, '-', ' ')))[1] AS weight_class, {any_in('n', cards.TITLE_BOUT)} AS title_fight FROM cn),
r AS (SELECT id, 'replacement' AS change_type, goes AS before_text, comes AS after_text, why AS reason, segment, weight_class, title_fight FROM cp WHERE {norm('comes')} <> {norm('goes')}
 UNION ALL SELECT id, 'cancellation', coalesce(ps[1], who), 'Bout is off', why, segment, weight_class, title_fight FROM cp WHERE category = 'cancellation'
 UNION ALL SELECT id, 'new_fight', NULL, unnest(list_filter(ps, lambda x, i: list_position(ps, x) = i)[1:2]), NULL, segment, weight_class, title_fight FROM cp WHERE category = 'fight_announcement'
 UNION ALL SELECT id, 'cancellation', coalesce(ps[1], who), coalesce(who, 'Fighter') || ' is out of the bout', coalesce(why, 'injury'), segment, weight_class, title_fight FROM cp WHERE category = 'injury' AND {any_in('n', cards.WITHDRAWAL)})
SELECT * FROM r"""
)
def res_card_changes(spark, sf_dir):
    """RES-10: what articles report about cards; every third names a stand-in in its text."""
    rows, k = classify.categorise(cleaned(spark, sf_dir)), F.col("id")
    last = lambda c: F.substring_index(c, " ", -1)
    more = F.when(k % 3 == 0, F.concat(F.lit(" Today "), last("a"), F.lit(" "), pick(F.floor(k / 3), MEET), F.lit(" "), last("b"), F.lit("."))).otherwise(F.lit(""))
    texts = rows.select("id", "title", F.concat("body", more).alias("body"), "category", F.when(k % 5 > 0, F.array("a")).otherwise(F.array().cast("array<string>")).alias("entities"))
    return cards.detect_changes(texts)


LOGGED = f"""lg AS (SELECT c_custkey AS k, c_nationkey AS event, {chosen('c_custkey', ['replacement', 'cancellation', 'new_fight'])} AS change_type, {person_sql('c_custkey // 3')} AS before_text, {person_sql('c_custkey // 5')} AS after_text, {chosen('c_custkey // 2', ['injury', 'visa issue'])} AS reason, {chosen('c_custkey', newsroom.SOURCES)} AS source_name,
 c_custkey % 4 = 0 AS official, {chosen('c_custkey // 7', ['CONFIRMED', 'REPORTED', 'RUMOR'])} AS status, TIMESTAMP '1998-01-01' + to_hours((c_custkey * 37) % 1000) AS t0 FROM customer)"""


def reports(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("k"), F.col("c_nationkey").alias("event"), pick(k, ["replacement", "cancellation", "new_fight"]).alias("change_type"), person(F.floor(k / 3)).alias("before_text"), person(F.floor(k / 5)).alias("after_text"), pick(F.floor(k / 2), ["injury", "visa issue"]).alias("reason"),
        pick(k, newsroom.SOURCES).alias("source_name"), (k % 4 == 0).alias("official"), pick(F.floor(k / 7), ["CONFIRMED", "REPORTED", "RUMOR"]).alias("status"), (F.lit("1998-01-01").cast("timestamp") + F.make_dt_interval(hours=(k * 37 % 1000).cast("int"))).alias("detected_at"),
    )


LOG_SQL = """lo AS (SELECT event, change_type, after_text, first(before_text ORDER BY t0, source_name, before_text, reason) AS before_text, first(reason ORDER BY t0, source_name, before_text, reason) AS reason, coalesce(first(source_name ORDER BY t0, source_name) FILTER (official OR status = 'CONFIRMED'), first(source_name ORDER BY t0, source_name, before_text, reason)) AS source_name,
 CASE WHEN bool_or(official OR status = 'CONFIRMED') THEN 'CONFIRMED' ELSE 'REPORTED' END AS status, min(t0) AS t0 FROM lg GROUP BY ALL)"""


@query(f"WITH {LOGGED}, {LOG_SQL} SELECT event, change_type, after_text, before_text, reason, source_name, status, strftime(t0, '%Y-%m-%d %H') AS at FROM lo")
def res_change_log(spark, sf_dir):
    """RES-11"""
    return cards.change_log(reports(spark, sf_dir)).select("event", "change_type", "after_text", "before_text", "reason", "source_name", "status", F.date_format("detected_at", "yyyy-MM-dd HH").alias("at"))


@query(f"WITH {LOGGED}, half AS (SELECT * FROM lg WHERE k % 2 = 0), new AS (SELECT * FROM lg l WHERE k % 2 > 0 AND NOT EXISTS (SELECT 1 FROM half h WHERE h.event = l.event AND h.change_type = l.change_type AND h.after_text = l.after_text)) SELECT change_type, count(*) AS changes FROM new GROUP BY 1")
def join_known_changes(spark, sf_dir):
    """JOIN-16, FLT-10: reports that the log of the others doesn't hold, by type."""
    rows = reports(spark, sf_dir)
    return cards.changes_by_type(cards.known_change(rows.filter("k % 2 > 0"), cards.change_log(rows.filter("k % 2 = 0"))))


APPLIED = f"""{LOGGED}, {LOG_SQL}, bt AS (SELECT DISTINCT c_nationkey AS event, array_to_string(list_sort([{norm(person_sql('c_custkey // 3'))}, {norm(person_sql('c_custkey + 1'))}]), '|') AS pair_key, 'scheduled' AS status FROM customer),
sd AS (SELECT event, pair_key, string_split(pair_key, '|') AS sides, unnest(string_split(pair_key, '|')) AS name FROM bt), rp AS (SELECT event, {norm('before_text')} AS name, {norm('after_text')} AS comes FROM lo WHERE change_type = 'replacement'),
ht AS (SELECT sd.event, pair_key, sides, min({{'name': sd.name, 'comes': comes}}) AS x FROM sd JOIN rp ON sd.event = rp.event AND sd.name = rp.name GROUP BY ALL),
ad AS (SELECT DISTINCT event, array_to_string(list_sort(list_append(list_filter(sides, lambda s: s <> x['name']), x['comes'])), '|') AS pair_key FROM ht), of AS (SELECT DISTINCT event, {norm('before_text')} AS pair_key FROM lo WHERE change_type = 'cancellation')"""


@query(
    f"""WITH {APPLIED} SELECT bt.event, bt.pair_key, CASE WHEN of.event IS NOT NULL THEN 'cancelled' WHEN ht.event IS NOT NULL THEN 'changed' ELSE bt.status END AS status FROM bt LEFT JOIN of ON bt.event = of.event AND bt.pair_key = of.pair_key LEFT JOIN ht ON bt.event = ht.event AND bt.pair_key = ht.pair_key
 UNION ALL SELECT event, pair_key, 'reported' FROM ad WHERE NOT EXISTS (SELECT 1 FROM bt WHERE bt.event = ad.event AND bt.pair_key = ad.pair_key)"""
)
def res_applied_changes(spark, sf_dir):
    """RES-11: cards after the log's changes."""
    k = F.col("c_custkey")
    pair = F.array_join(F.array_sort(F.array(text.normalize(person(F.floor(k / 3))), text.normalize(person(k + 1)))), "|")
    card = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("event"), pair.alias("pair_key"), F.lit("scheduled").alias("status")).distinct()
    return cards.apply_changes(card, cards.change_log(reports(spark, sf_dir)))


OFFICIAL_TYPES = "source_type IN ('OFFICIAL','MAJOR_NEWS','ESTABLISHED_JOURNALIST','TRUSTED_REPORTER')"
NAMED_EVENTS = [(312, "UFC 312", "312"), (299, "UFC 299: Finale", "UFC 299"), (88, "UFC Vegas 88", ""), (1, "UFC Fight Night", "Fight Night")]
MENTIONED = "CASE id % 14 WHEN 0 THEN ['UFC 312'] WHEN 1 THEN ['ufc fight night', 'UFC 312'] WHEN 2 THEN ['UFC 299'] WHEN 4 THEN ['UFC Vegas 88', 'ufc vegas 88'] ELSE ['Elsewhere'] END"


@query(
    f"""WITH {ENRICHED}, m AS (SELECT id, {MENTIONED} AS evs, {norm("title || ' ' || body")} AS w, category, intent, typed AS source_type, typed = 'OFFICIAL' AND len(outlets) = 0 AS official FROM enriched WHERE NOT has_denial),
x AS (SELECT DISTINCT id, w, category, intent, source_type, official, unnest(list_transform(evs, lambda e: {norm('e')})) AS n FROM m), ek AS (SELECT *, CASE n WHEN 'ufc 312' THEN 312 WHEN 'ufc 299' THEN 299 WHEN 'ufc vegas 88' THEN 88 WHEN 'ufc fight night' THEN 1 END AS event FROM x),
k AS (SELECT *, unnest(list_filter([CASE WHEN {any_in('w', cards.CANCEL)} AND category IN ('cancellation', 'event_change', 'general') THEN 'cancelled' WHEN {any_in('w', cards.POSTPONE)} THEN 'postponed' END,
 CASE WHEN intent IN ('RESULT', 'POST_FIGHT') AND {OFFICIAL_TYPES} THEN 'completed' WHEN {any_in('w', cards.LIVE)} THEN 'live' END], lambda t: t IS NOT NULL)) AS kind FROM ek WHERE event IS NOT NULL)
SELECT DISTINCT event, id, kind, source_type, official FROM k"""
)
def res_event_evidence(spark, sf_dir):
    """RES-4, JOIN-15: what articles say of the events that they name."""
    r = F.col("id") % 14
    names = F.when(r == 0, F.array(F.lit("UFC 312"))).when(r == 1, F.array(F.lit("ufc fight night"), F.lit("UFC 312"))).when(r == 2, F.array(F.lit("UFC 299"))).when(r == 4, F.array(F.lit("UFC Vegas 88"), F.lit("ufc vegas 88"))).otherwise(F.array(F.lit("Elsewhere")))
    known = constants(spark, NAMED_EVENTS, "event int, name string, short_name string")
    return cards.event_evidence(enriched(spark, sf_dir).withColumn("events", names), known).select("event", "id", "kind", "source_type", "official")


@query(
    """WITH e AS (SELECT o_orderkey AS event, ['UPCOMING','LIVE','COMPLETED','UNKNOWN','CANCELLED','POSTPONED'][o_orderkey % 6 + 1] AS status, CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS start, CASE WHEN o_orderkey % 7 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders)
SELECT event, CASE WHEN start IS NOT NULL THEN 'start known' WHEN day IS NOT NULL THEN 'date known' ELSE 'nothing known' END AS schedule, CASE status WHEN 'CANCELLED' THEN 'Cancelled, by the collected sources.'
 WHEN 'POSTPONED' THEN CASE WHEN start IS NOT NULL THEN 'Postponed, by the collected sources; the schedule still says ' || start || '.' ELSE 'Postponed, by the collected sources; no new date is known.' END WHEN 'COMPLETED' THEN 'Over, by reliable evidence.'
 WHEN 'LIVE' THEN coalesce('Started at ' || start || ' and within its expected length.', CASE WHEN day IS NOT NULL THEN 'On ' || day || '; without a start nobody can tell whether it is over.' ELSE 'No schedule is known.' END)
 WHEN 'UPCOMING' THEN CASE WHEN start IS NOT NULL THEN 'Starts at ' || start || '.' WHEN day IS NOT NULL THEN 'On ' || day || '; no start is known.' ELSE 'Announced without a date.' END
 ELSE CASE WHEN start IS NOT NULL THEN 'Should have started at ' || start || '; nothing confirms that it took place.' WHEN day IS NOT NULL THEN 'On ' || day || '; without a start nobody can tell whether it is over.' ELSE 'No schedule is known.' END END AS explanation FROM e"""
)
def res_schedule(spark, sf_dir):
    """RES-7"""
    k = F.col("o_orderkey")
    start, day = F.when(k % 5 > 0, F.col("o_orderdate").cast("timestamp")), F.when(k % 7 > 0, F.to_date("o_orderdate"))
    rows = table(spark, sf_dir, "orders").select(k.alias("event"), pick(k, ["UPCOMING", "LIVE", "COMPLETED", "UNKNOWN", "CANCELLED", "POSTPONED"]).alias("status"), start.alias("start"), day.alias("day"))
    return rows.select("event", cards.schedule_state(F.col("start"), F.col("day")).alias("schedule"), cards.status_explanation(F.col("status"), F.col("start"), F.col("day")).alias("explanation"))


ORIGINS = ["detected", "official", "user", "detected"]


@query(
    f"""WITH r AS (SELECT l_suppkey AS event, {chosen('l_orderkey', ORIGINS)} <> 'detected' AS firm, epoch(l_shipdate)::BIGINT + l_orderkey AS t, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS name, CASE WHEN l_linenumber % 3 = 0 THEN l_linestatus || l_linenumber END AS venue FROM lineitem)
SELECT event, last(name ORDER BY firm, CASE WHEN firm THEN t ELSE -t END, name) FILTER (name IS NOT NULL) AS name, last(venue ORDER BY firm, CASE WHEN firm THEN t ELSE -t END, venue) FILTER (venue IS NOT NULL) AS venue FROM r GROUP BY event"""
)
def res_precedence(spark, sf_dir):
    """RES-3: official and user rows overwrite by time, detected ones fill gaps."""
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("event"), pick(F.col("l_orderkey"), ORIGINS).alias("data_origin"), (F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(secs=F.col("l_orderkey"))).alias("at"),
        F.when(n % 2 == 0, F.col("l_returnflag")).alias("name"), F.when(n % 3 == 0, F.concat("l_linestatus", n)).alias("venue"),
    )
    return resolve.merge_by_authority(rows, "event", ["name", "venue"])


RECORDS = [" (12-3-0)", " 12-3", "", " – "]
HEADINGS = ["Light Heavyweight Title Bout", "Women's Strawweight Bout", "Lightweight bout", "Championship", ""]


@query(
    f"""WITH o AS (SELECT o_custkey AS event, o_orderkey AS pos, {person_sql('o_custkey + o_orderkey % 3')} AS a, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE {person_sql('o_orderkey')} END AS b, {chosen('o_orderkey', HEADINGS)} AS heading, {chosen('o_orderkey', ['main_card', 'prelims', 'main_card'])} AS seg FROM orders),
p AS (SELECT *, array_to_string(list_sort([{norm('a')}, {norm('b')}]), '|') AS pair_key FROM o WHERE a <> '' AND b <> ''), f AS (SELECT *, row_number() OVER (PARTITION BY event, pair_key ORDER BY pos) AS r FROM p),
d AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY pos) AS bout_order FROM f WHERE r = 1)
SELECT event, pair_key, a AS fighter_a, bout_order::INTEGER AS bout_order, CASE WHEN bout_order = 1 THEN 'main_event' WHEN bout_order = 2 AND seg = 'main_card' THEN 'co_main' ELSE seg END AS segment,
 CASE WHEN heading LIKE 'Light H%' THEN 'Light Heavyweight' WHEN heading LIKE '%Straw%' THEN 'Strawweight' WHEN heading LIKE 'Lightw%' THEN 'Lightweight' END AS weight_class, heading LIKE '%Title%' OR heading LIKE 'Champ%' AS is_title_fight FROM d"""
)
def res_official_card(spark, sf_dir):
    """RES-17: names without records, each pair once, by the order of the list."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    a = F.concat(F.lit("– "), person(c + k % 3), pick(k, RECORDS))
    b = F.when(k % 17 == 0, F.lit(" (1-0) ")).otherwise(F.concat(person(k), pick(F.floor(k / 2), RECORDS)))
    rows = table(spark, sf_dir, "orders").select(c.alias("event"), k.alias("pos"), a.alias("fighter_a"), b.alias("fighter_b"), pick(k, HEADINGS).alias("heading"), pick(k, ["main_card", "prelims", "main_card"]).alias("segment"))
    return cards.official_card(rows).select("event", "pair_key", "fighter_a", "bout_order", "segment", "weight_class", "is_title_fight")


PRINTED = ["men's pound for pound", "LIGHT-HEAVYWEIGHT", "Flyweight ", "Open  Class"]
CLEANED = ["Men's Pound-for-Pound", "Light Heavyweight", "Flyweight", "Open Class"]
PAGES = ["The Meta UFC Rankings of today", "official  ufc ranking", "UFC rankings presented by Acme Corp. and", "no label"]
LABELS = ["Meta UFC Rankings", "Official UFC Rankings", "UFC Rankings (presented by)", "unlabelled"]
PHRASES = ["Meta UFC Rankings", "official ufc ranking", "UFC rankings presented by Acme Corp", "unlabelled"]


@query(
    f"""WITH r AS (SELECT c_custkey AS pos, {chosen('c_custkey', CLEANED)} AS division, {person_sql('c_custkey // 4')} AS name, {chosen('c_custkey', LABELS)} AS system, {chosen('c_custkey', PHRASES)} AS version FROM customer), f AS (SELECT *, row_number() OVER (PARTITION BY division, {norm('name')} ORDER BY pos) AS r FROM r)
SELECT division, name, pos, system, version FROM f WHERE r = 1"""
)
def res_rank_cleanup(spark, sf_dir):
    """RES-16: one row per division and name, with the published labels."""
    k = F.col("c_custkey")
    label = cards.ranking_system(pick(k, PAGES))
    rows = table(spark, sf_dir, "customer").select(k.alias("pos"), pick(k, PRINTED).alias("division"), person(F.floor(k / 4)).alias("name"), label["system_name"].alias("system"), label["system_version"].alias("version"))
    return cards.clean_rankings(rows).select("division", "name", "pos", "system", "version")


@query(f"WITH {ENRICHED} SELECT id, CASE WHEN id % 2 = 0 THEN 'STORED' ELSE intent END AS intent, CASE WHEN id % 3 = 0 THEN -1 ELSE speculation_score END::DOUBLE AS speculation_score FROM enriched")
def res_backfill(spark, sf_dir):
    """RES-18: rows stored before a rule take what it gives; others keep what they have."""
    k = F.col("id")
    rows = enriched(spark, sf_dir).select("id", F.when(k % 2 == 0, F.lit("STORED")).alias("intent"), F.when(k % 3 == 0, F.lit(-1.0)).alias("speculation_score"), F.col("intent").alias("new_intent"), F.col("speculation_score").alias("new_score"))
    return cards.backfill(rows, {"intent": F.col("new_intent"), "speculation_score": F.col("new_score")}).select("id", "intent", "speculation_score")


@query(
    """WITH t AS (SELECT DISTINCT * FROM (SELECT c_custkey AS story, o_orderdate AS t0, 'article' AS kind, o_orderpriority AS headline FROM customer JOIN orders ON o_custkey = c_custkey UNION ALL SELECT user_id, date_trunc('day', ts), 'social', event_type FROM events UNION ALL SELECT user_id, date_trunc('day', ts), 'status_change', event_type FROM events WHERE event_type = 'error'))
SELECT story, strftime(t0, '%Y-%m-%d') AS day, kind, headline, (row_number() OVER (PARTITION BY story ORDER BY t0, kind, headline))::INTEGER AS place FROM t"""
)
def res_timeline(spark, sf_dir):
    """RES-14, SET-1: entries of three kinds, each once, oldest first."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("story"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("headline"))
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("story"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderpriority").alias("headline"))
    rows = resolve.story_timeline({"article": o, "social": e, "status_change": e.filter("headline = 'error'")})
    place = F.row_number().over(Window.partitionBy("story").orderBy("at", "kind", "headline"))
    return rows.select("story", F.date_format("at", "yyyy-MM-dd").alias("day"), "kind", "headline", place.alias("place"))


GENERATED = ['Bout ends 12-3 in "the two sides agreed" style', "He earned $5,000 and 40% more", 'They said "we will be ready for this one" and "nobody ever said these words here"', "{subject} wins", "nothing to check in this story"]


@query(
    f"""WITH {ARTICLES}, g AS (SELECT id, {chosen('id', GENERATED)} AS made, title || ' ' || body || CASE WHEN id % 4 = 0 THEN ' 12-3 $5,000' ELSE '' END AS src FROM art), n AS (SELECT *, {norm('src')} AS w FROM g),
f AS (SELECT *, list_distinct(regexp_extract_all(made, '(\\d+-\\d+(?:-\\d+)?|[$€£]\\d[\\d,.]*|\\d+(?:\\.\\d+)?%)', 1)) AS figures, regexp_extract_all(made, '["“]([^"“”]{{10,400}})["”]', 1) AS quotes FROM n)
SELECT id, array_to_string(list_sort(list_filter(figures, lambda x: NOT contains(' ' || w || ' ', ' ' || {norm('x')} || ' '))), '|') AS figures, len(list_filter(quotes, lambda q: NOT (contains(w, {norm('q')}) OR (len(string_split({norm('q')}, ' ')) >= 8 AND
 len(list_filter(range(1, greatest(len(string_split({norm('q')}, ' ')) - 5, 1) + 1), lambda i: contains(w, array_to_string(string_split({norm('q')}, ' ')[i:i + 5], ' ')))) > 0))))::BIGINT AS quotes,
 made LIKE '{{subject}}%' OR made LIKE '%this story' AS placeholder FROM f"""
)
def cls_generated(spark, sf_dir):
    """CLS-13, 16: figures and quotes of generated texts that their sources don't hold, and forgotten placeholders."""
    k = F.col("id")
    made, source = pick(k, GENERATED), F.concat_ws(" ", "title", "body", F.when(k % 4 == 0, F.lit("12-3 $5,000")))
    rows = newsroom.articles(spark, sf_dir).select("id", made.alias("made"), classify.grounded(made, source).alias("g"))
    return rows.select("id", F.array_join(F.array_sort("g.figures"), "|").alias("figures"), F.size("g.quotes").cast("long").alias("quotes"), cards.has_placeholder(F.col("made")).alias("placeholder"))


@query(
    f"""WITH {ENRICHED}, d AS (SELECT *, category IN ('fight_announcement', 'cancellation', 'replacement') AS bout, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS n_events FROM enriched)
SELECT id, array_to_string(list_filter([CASE WHEN bout AND n_events = 0 THEN 'event not named' END, CASE WHEN bout AND NOT regexp_matches(x, '\\b(january|february|march|april|may|june|july|august|september|october|november|december)\\b') THEN 'no date given' END,
 CASE WHEN category = 'fight_announcement' AND NOT contains(x, 'weight') THEN 'weight class not stated' END, CASE WHEN category = 'injury' AND NOT regexp_matches(x, '\\b(weeks?|months?|surgery)\\b') THEN 'no recovery timeline' END,
 CASE WHEN category = 'cancellation' AND NOT contains(x, 'replac') THEN 'no replacement named' END, CASE WHEN category IN ('controversy', 'suspension') AND NOT regexp_matches(x, '\\bstatement\\b') THEN 'no official statement' END], lambda t: t IS NOT NULL)[1:5], '; ') AS missing,
 array_to_string(list_concat(list_filter([CASE WHEN length(body) < 80 AND len(regexp_extract_all(body, '[.!?]\\s+[A-Z0-9"''“]')) = 0 THEN 'short post, little context' END, CASE WHEN id % 3 = 0 THEN 'names nobody' END,
 CASE typed WHEN 'OFFICIAL' THEN 'official account: confirms only what it states' WHEN 'UNKNOWN' THEN 'unverified account' WHEN 'FAN_ACCOUNT' THEN 'unverified account' END], lambda t: t IS NOT NULL), ['see: ' || a, 'see: ' || b]), '; ') AS caveats FROM d"""
)
def cls_caveats(spark, sf_dir):
    """CLS-14, 15: what reports leave open, and what to keep in mind of posts."""
    rows, k, none = enriched(spark, sf_dir), F.col("id"), F.array().cast("array<string>")
    words = text.normalize(F.concat_ws(" ", "title", "body"))
    missing = classify.missing_details(F.col("category"), F.when(k % 2 == 0, F.array(F.lit("UFC 1"))).otherwise(none), words)
    caveats = cards.post_caveats(F.col("body"), F.when(k % 3 == 0, none).otherwise(F.array("a")), F.col("source_type"), F.array("a", "b"))
    return rows.select("id", F.array_join(missing, "; ").alias("missing"), F.array_join(caveats, "; ").alias("caveats"))
