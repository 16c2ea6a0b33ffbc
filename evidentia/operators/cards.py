"""Fight cards: changes reported by articles, official cards, ranking pages, evidence typing
(RES-4, 7, 10, 11, 16 to 18, AGG-24, CLS-15, 16, FLT-9, 10)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CAPITALISED, any_of, collapse, normalize, run_of, sentences
from ..functions.timefn import to_iso
from .classify import _hit, computed, may_establish_result
from .entities import WEIGHT_CLASSES, find_matchups, weight_classes
from .resolve import MONTHS

#: Wording of reasons, segments, withdrawals and evidence; labels of divisions and systems.
REASONS = {
    "injury": ["injury", "injured", "torn", "surgery", "broken"],
    "failed drug test": ["failed drug test", "doping", "anti-doping", "flagged"],
    "weight miss": ["missed weight", "weight miss"],
    "illness": ["illness", "ill", "sick"],
    "visa issue": ["visa"],
    "undisclosed reason": ["undisclosed"],
}
#: The co-main event stands first: its name holds that of the main event.
SEGMENTS = {
    "co_main": ["co-main", "co main event"],
    "main_event": ["main event", "headliner", "headline the card", "will headline"],
    "prelims": ["prelim", "preliminary card"],
    "main_card": ["main card"],
}
STEPPING_IN = ["replaces", "replace", "steps in for", "takes the place of"]
WITHDRAWAL = ["out of", "withdraws", "withdrawn", "withdrawal", "pulled out", "forced out", "off the card", "will not compete"]
CANCEL = ["cancelled", "canceled", "called off", "scrapped", "axed", "off the card"]
POSTPONE = ["postponed", "pushed back", "rescheduled", "moved to", "delayed"]
LIVE = ["live results", "live blog", "round by round", "live updates"]
TITLE_BOUT = ["title fight", "title bout", "championship bout", "for the title", "for the belt", "interim title", "undisputed title", "title defense"]
DIVISIONS = [
    "Men's Pound-for-Pound", "Women's Pound-for-Pound", "Pound-for-Pound", "Flyweight", "Bantamweight", "Featherweight", "Lightweight", "Welterweight", "Middleweight", "Light Heavyweight", "Heavyweight",
    "Women's Strawweight", "Women's Flyweight", "Women's Bantamweight", "Women's Featherweight", "Strawweight",
]
#: Labels of ranking systems, the special ones before the plain one.
SYSTEMS = ["Meta UFC Rankings", "UFC Rankings (presented by)", "Official UFC Rankings", "UFC Rankings"]
PLACEHOLDERS = ["this story", "that story", "the topic", "this topic", "the event", "this event", "placeholder", "this subject", "the subject"]
MARKERS = ["{subject}", "{event}", "{fighter}", "{claim}", "{0}", "{1}"]


def first_group(text: Column, groups: dict[str, list[str]]) -> Column:
    """The first group with a term in the normalised text; short terms are whole words."""
    tests = []
    for name, terms in groups.items():
        hit = _hit(text, terms[0])
        for t in terms[1:]:
            hit = hit | _hit(text, t)
        tests.append(F.when(hit, F.lit(name)))
    return F.coalesce(*tests)


CHANGE = "array<struct<change_type:string,before_text:string,after_text:string,reason:string>>"


def said(raw: Column) -> Column:
    """(comes, goes): the names around the first verb of a replacement; null where there is none."""
    name = run_of(CAPITALISED, 3)
    verbs = "|".join(v.replace(" ", r"\s+") for v in STEPPING_IN)
    words = rf"({name})\s+(?:will\s+)?(?:{verbs})\s+({name})"
    side = lambda k: F.nullif(F.rtrim(F.regexp_extract(raw, words, k), F.lit(".")), F.lit(""))
    # a name may be of many words, and where no verb is there is nothing to look for
    return F.when(raw.rlike(rf"\s(?:{verbs})\s"), F.struct(side(1).alias("comes"), side(2).alias("goes")))


def stand_ins(both: Column) -> Column:
    """Who steps in, and for whom (see `said`); null where none is named or both are one."""
    return F.when(both["comes"].isNotNull() & (normalize(both["comes"]) != normalize(both["goes"])), both)


def detect_changes(articles: DataFrame) -> DataFrame:
    """RES-10: one row per card change that an article (id, title, body, category, entities) reports.

    A replacement is read from the text itself, whatever the category; the category says what else is
    looked for: bouts that are off, bouts that are new (two at most), fighters who are out."""
    # a text is cleaned and searched once, not once for every term and column that it is held against
    rows = computed(articles, {"raw": collapse(F.concat_ws(". ", "title", "body"))})
    rows = computed(rows, {"said": said(F.col("raw"))})
    # what names no replacement and is of no such category reports none, and is searched no further
    listed = F.coalesce(F.col("category").isin("cancellation", "fight_announcement", "injury"), F.lit(False))
    rows = rows.filter(F.col("said.comes").isNotNull() | listed)
    rows = computed(rows, {"norm": normalize(F.col("raw")), "bouts": F.when(listed, find_matchups(F.col("raw")))})
    rows = computed(rows, {"swap": stand_ins(F.col("said")), "why": first_group(F.col("norm"), REASONS)})
    who, none = F.get("entities", F.lit(0)), F.lit(None).cast("string")
    whose = F.coalesce(F.get("bouts", F.lit(0)), who)
    row = lambda kind, before, after, why: F.array(F.struct(F.lit(kind).alias("change_type"), before.alias("before_text"), after.alias("after_text"), why.alias("reason"))).cast(CHANGE)
    by_category = {
        "cancellation": row("cancellation", whose, F.lit("Bout is off"), F.col("why")),
        "fight_announcement": F.flatten(F.transform(F.slice("bouts", 1, 2), lambda b: row("new_fight", none, b, none))),
        "injury": F.when(any_of(F.col("norm"), WITHDRAWAL), row("cancellation", whose, F.concat(F.coalesce(who, F.lit("Fighter")), F.lit(" is out of the bout")), F.coalesce("why", F.lit("injury")))),
    }
    swap = F.when(F.col("swap").isNotNull(), row("replacement", F.col("swap.goes"), F.col("swap.comes"), F.col("why")))
    listed = F.coalesce(*(F.when(F.col("category") == c, found) for c, found in by_category.items()))
    empty = F.array().cast(CHANGE)
    found = rows.withColumn("change", F.explode(F.concat(F.coalesce(swap, empty), F.coalesce(listed, empty))))
    n = F.col("norm")
    return found.select("id", "change.*", first_group(n, SEGMENTS).alias("segment"), F.get(weight_classes(n), F.lit(0)).alias("weight_class"), any_of(n, TITLE_BOUT).alias("title_fight"))


def apply_changes(bouts: DataFrame, log: DataFrame) -> DataFrame:
    """RES-11: bouts (event, pair_key, status) after the logged changes: a cancellation takes its bout off, a
    replacement marks the bout of who leaves and adds that of who comes in."""
    rows = bouts.withColumn("sides", F.split("pair_key", r"\|"))
    by_name = rows.select("event", "pair_key", "status", F.explode("sides").alias("name"), "sides")
    out = log.filter("change_type = 'replacement'").select("event", normalize(F.col("before_text")).alias("name"), normalize(F.col("after_text")).alias("comes"))
    hit = by_name.join(out, ["event", "name"]).groupBy("event", "pair_key", "sides").agg(F.min(F.struct("name", "comes")).alias("x"))
    changed = hit.select("event", "pair_key", F.lit("changed").alias("new_status"))
    added = hit.select("event", F.array_join(F.array_sort(F.array_append(F.array_remove("sides", F.col("x.name")), F.col("x.comes"))), "|").alias("pair_key"), F.lit("reported").alias("status"))
    off = log.filter("change_type = 'cancellation'").select("event", F.array_join(F.array_sort(F.transform(F.split(F.regexp_replace("before_text", r"(?i)\s+vs\.?\s+", "|"), r"\|"), normalize)), "|").alias("pair_key"), F.lit("cancelled").alias("new_status")).distinct()
    marks = changed.unionByName(off).groupBy("event", "pair_key").agg(F.min("new_status").alias("new_status"))  # off goes before changed
    kept = bouts.join(marks, ["event", "pair_key"], "left").select("event", "pair_key", F.coalesce("new_status", "status").alias("status"))
    return kept.unionByName(added.distinct().join(bouts, ["event", "pair_key"], "left_anti"))


def change_log(changes: DataFrame) -> DataFrame:
    """RES-11, JOIN-16: the first report of each (event, type, after), upgraded by official or confirmed repeats."""
    strong = F.col("official") | (F.col("status") == "CONFIRMED")
    first = F.min_by(F.struct("source_name", "before_text", "reason"), F.struct("detected_at", "source_name", "before_text", "reason"))
    best = F.min_by("source_name", F.when(strong, F.struct("detected_at", "source_name")))
    rows = changes.groupBy("event", "change_type", "after_text").agg(first.alias("f"), best.alias("by"), F.count_if(strong).alias("n"), F.min("detected_at").alias("detected_at"))
    return rows.select("event", "change_type", "after_text", "f.before_text", "f.reason", F.coalesce("by", "f.source_name").alias("source_name"), F.when(F.col("n") > 0, F.lit("CONFIRMED")).otherwise("REPORTED").alias("status"), "detected_at")


def changes_by_type(log: DataFrame) -> DataFrame:
    """FLT-10"""
    return log.groupBy("change_type").agg(F.count(F.lit(1)).alias("changes"))


def event_evidence(articles: DataFrame, events: DataFrame) -> DataFrame:
    """RES-4, JOIN-15: what articles (id, at, title, body, events, category, intent, source_type,
    is_official, has_denial) say about events (event, name, short_name)."""
    names = events.select("event", F.explode(F.array_distinct(F.array(normalize(F.col("name")), normalize(F.col("short_name"))))).alias("n")).filter("n <> ''")
    rows = articles.filter(~F.col("has_denial")).withColumn("n", F.explode(F.array_distinct(F.transform("events", normalize)))).join(names, "n")
    rows, text = computed(rows, {"said__": normalize(F.concat_ws(" ", "title", "body"))}), F.col("said__")
    off = F.when(any_of(text, CANCEL) & F.col("category").isin("cancellation", "event_change", "general"), F.lit("cancelled")).when(any_of(text, POSTPONE), "postponed")
    done = F.when(may_establish_result(F.col("intent"), F.col("source_type")), F.lit("completed")).when(any_of(text, LIVE), "live")
    return rows.withColumn("kind", F.explode(F.array_compact(F.array(off, done)))).select("event", "id", "kind", "at", "source_type", F.col("is_official").alias("official")).distinct()


def known_change(changes: DataFrame, log: DataFrame) -> DataFrame:
    """JOIN-16: changes that the log doesn't hold yet; an unknown event equals an unknown one."""
    same = changes["event"].eqNullSafe(log["event"]) & changes["change_type"].eqNullSafe(log["change_type"]) & changes["after_text"].eqNullSafe(log["after_text"])
    return changes.join(log, same, "left_anti")


def schedule_state(start: Column, date: Column) -> Column:
    """RES-7"""
    return F.when(start.isNotNull(), F.lit("start known")).when(date.isNotNull(), "date known").otherwise("nothing known")


def status_explanation(status: Column, start: Column, date: Column) -> Column:
    """RES-7: a sentence about an event's status that is true of what is known of its schedule."""
    at, day, exact, dated = to_iso(start), date.cast("string"), start.isNotNull(), date.isNotNull()
    by_status = {
        "CANCELLED": F.lit("Cancelled, by the collected sources."),
        "POSTPONED": F.when(exact, F.concat(F.lit("Postponed, by the collected sources; the schedule still says "), at, F.lit("."))).otherwise(F.lit("Postponed, by the collected sources; no new date is known.")),
        "COMPLETED": F.lit("Over, by reliable evidence."),
        "LIVE": F.concat(F.lit("Started at "), at, F.lit(" and within its expected length.")),
        "UPCOMING": F.when(exact, F.concat(F.lit("Starts at "), at, F.lit("."))).when(dated, F.concat(F.lit("On "), day, F.lit("; no start is known."))).otherwise(F.lit("Announced without a date.")),
    }
    unknown = F.when(exact, F.concat(F.lit("Should have started at "), at, F.lit("; nothing confirms that it took place."))).when(dated, F.concat(F.lit("On "), day, F.lit("; without a start nobody can tell whether it is over."))).otherwise(F.lit("No schedule is known."))
    return F.coalesce(*(F.when(status == s, text) for s, text in by_status.items()), unknown)


def clean_name(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(c, r"\s*\(.*?\)\s*", " "), r"\b\d+-\d+(-\d+)?\b", "")
    return collapse(F.regexp_replace(bare, r"^[\s–—-]+|[\s–—-]+$", ""))


def official_card(bouts: DataFrame) -> DataFrame:
    """RES-17: listed bouts (event, pos, fighter_a, fighter_b, heading, segment) normalised; each pair
    once, the first listed is the main event, the second of the main card the co-main."""
    rows = bouts.withColumns({"fighter_a": clean_name(F.col("fighter_a")), "fighter_b": clean_name(F.col("fighter_b"))})
    key = F.array_join(F.array_sort(F.array(normalize(F.col("fighter_a")), normalize(F.col("fighter_b")))), "|")
    rows = rows.withColumn("pair_key", key).filter(~F.col("pair_key").rlike(r"^\||\|$"))
    rest = ["pos", "fighter_a", "fighter_b", "heading", "segment"]
    once = rows.groupBy("event", "pair_key").agg(F.min_by(F.struct(*rest), "pos").alias("b")).select("event", "pair_key", "b.*")
    place = F.row_number().over(Window.partitionBy("event").orderBy("pos"))  # a card has few bouts
    text = normalize(F.col("heading"))
    longest = F.coalesce(*(F.when(text.contains(w), F.initcap(F.lit(w))) for w in sorted(WEIGHT_CLASSES, key=len, reverse=True)))
    segment = F.when(F.col("bout_order") == 1, F.lit("main_event")).when((F.col("bout_order") == 2) & (F.col("segment") == "main_card"), "co_main").otherwise(F.col("segment"))
    return once.withColumn("bout_order", place).select("event", "pair_key", "fighter_a", "fighter_b", "bout_order", segment.alias("segment"), longest.alias("weight_class"), any_of(text, ["title", "championship"]).alias("is_title_fight"))


def clean_rankings(rows: DataFrame) -> DataFrame:
    """RES-16: one row per (division, name), the first listed, under the published division label."""
    words = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    known = F.coalesce(*(F.when(words(F.col("division")) == "".join(ch for ch in d.lower() if ch.isalpha()), F.lit(d)) for d in DIVISIONS), collapse(F.col("division")))
    keyed = rows.withColumns({"division": known, "key": normalize(F.col("name"))}).filter("key <> ''")
    rest = [c for c in keyed.columns if c not in ("division", "key")]
    return keyed.groupBy("division", "key").agg(F.min_by(F.struct(*rest), "pos").alias("r")).select("division", "r.*")


def system_pattern(label: str) -> str:
    """A label as pages write it: its words in any case and spacing, rankings in the singular too; what a label leaves
    open at its end is taken along."""
    words = [w + "?" if w == "rankings" else w for w in re.findall("[a-z]+", label.lower())]
    return "(?i)" + r"\s+".join(words) + (r"\s+[\w\s]+" if label.endswith(")") else "")


def ranking_system(page: Column) -> Column:
    """RES-16: the label that a page uses, and the phrase itself."""
    told = lambda label: F.substring(collapse(F.regexp_extract(page, system_pattern(label), 0)), 1, 80)
    labels = [F.when(page.rlike(system_pattern(label)), F.struct(F.lit(label).alias("system_name"), told(label).alias("system_version"))) for label in SYSTEMS]
    return F.coalesce(*labels, F.struct(F.lit("unlabelled").alias("system_name"), F.lit("unlabelled").alias("system_version")))


def ranking_date(page: Column) -> Column:
    """RES-16: the date that a page gives for its rankings, as a date: the first one that follows within a few words
    of "as of", "updated" or "rankings for"."""
    said = F.regexp_extract(page, r"(?i)\b(?:as\s+of|updated|rankings\s+for)\b\W*(\d{4}-\d{2}-\d{2}|[a-z]+\s+\d{1,2},\s+\d{4})", 1)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(said, "^([A-Za-z]+)", 1))).cast("string")
    spelled = F.when(month != "0", F.concat_ws("-", F.regexp_extract(said, r"(\d{4})$", 1), F.lpad(month, 2, "0"), F.lpad(F.regexp_extract(said, r"\s(\d{1,2}),", 1), 2, "0")))
    return F.coalesce(F.when(said.rlike(r"^\d"), said), spelled).try_cast("date")


def backfill(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """RES-18: derived columns where rows stored before their rule have none."""
    return rows.withColumns({c: F.coalesce(c, v) for c, v in columns.items()})


def has_placeholder(c: Column) -> Column:
    """CLS-16"""
    raw = F.coalesce(c, F.lit(""))
    return any_of(raw, MARKERS) | any_of(F.concat(F.lit(" "), normalize(raw), F.lit(" ")), [f" {p} " for p in PLACEHOLDERS])


def post_caveats(text: Column, entities: Column, account: Column, related: Column | None = None) -> Column:
    """CLS-15: what to keep in mind of a post; related: titles of stories that it belongs to, three at most."""
    short = (F.length(text) < 80) & (F.size(sentences(text)) == 1)
    by = F.when(account == "OFFICIAL", F.lit("official account: confirms only what it states")).when(account.isin("FIGHTER", "COACH_TEAM", "PROMOTER"), "first-person claim, not confirmation").when(account.isin("UNKNOWN", "FAN_ACCOUNT"), "unverified account")
    told = F.array_compact(F.array(F.when(short, F.lit("short post, little context")), F.when(F.size(entities) == 0, F.lit("names nobody")), by))
    return told if related is None else F.concat(told, F.transform(F.slice(F.coalesce(related, F.array().cast("array<string>")), 1, 3), lambda t: F.concat(F.lit("see: "), t)))


def radar_groups(posts: DataFrame, most: int = 6) -> DataFrame:
    """FLT-9: posts by kind of account, the most engaged of each group.  The cap is the report's."""
    group = F.when(F.col("account_type") == "OFFICIAL", F.lit("official")).when(F.col("account_type").isin("ESTABLISHED_JOURNALIST", "TRUSTED_REPORTER", "MAJOR_NEWS"), "journalist").when(F.col("account_type").isin("FIGHTER", "COACH_TEAM"), "fighter").when(F.col("speculation_score") > 0, "rumour").otherwise("other")
    order = Window.partitionBy("grp").orderBy(F.col("engagement").desc_nulls_last(), "post")
    return posts.withColumn("grp", group).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def knowledge(items: DataFrame) -> DataFrame:
    """AGG-24: what is confirmed, claimed and disputed in a story, each by its numbered sources.

    Sources are numbered by time; of one time by name, family, type and what they say, so that only rows
    alike in all of these could change places."""
    order = Window.partitionBy("story").orderBy("at", "name", "family", "source_type", "derivative", "denial", "speculation")
    rows = items.withColumn("number", F.row_number().over(order))
    numbers = lambda when: F.array_sort(F.collect_list(F.when(when, F.col("number"))))
    official = (F.col("source_type") == "OFFICIAL") & ~F.col("derivative")
    return rows.groupBy("story").agg(numbers(official).alias("confirmed_by"), numbers(~official & ~F.col("denial") & (F.col("speculation") < 0.34)).alias("reported_by"), numbers(~official & (F.col("speculation") >= 0.34)).alias("claimed_by"), numbers(F.col("denial")).alias("disputed_by"))
