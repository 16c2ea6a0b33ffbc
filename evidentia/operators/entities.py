"""Entities: dictionary, matching, mentions (ENT-*), and classification joins (JOIN-1..3)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NAME_PART, normalize, run_of, words_pattern
from .classify import source_type

#: Weight classes and title phrases.
WEIGHT_CLASSES = ["strawweight", "flyweight", "bantamweight", "featherweight", "lightweight", "welterweight", "middleweight", "light heavyweight", "heavyweight", "catchweight", "pound-for-pound"]


def build_dictionary(entities: DataFrame, ambiguous: list[str] = ()) -> DataFrame:
    """ENT-1: (phrase, entity, is_surname) from entity, name, aliases.  The first owner of a phrase
    wins; a surname counts only if one entity has it, it has five letters and isn't ambiguous."""
    names = entities.select("entity", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("raw"))
    phrases = names.select("entity", normalize(F.col("raw")).alias("phrase")).filter(F.length("phrase") >= 4)
    whole = phrases.groupBy("phrase").agg(F.min("entity").alias("entity")).withColumn("is_surname", F.lit(False))
    last = entities.select("entity", F.element_at(F.split(normalize(F.col("name")), " "), -1).alias("phrase"))
    last = last.filter((F.length("phrase") >= 5) & ~F.col("phrase").isin(*ambiguous) if ambiguous else F.length("phrase") >= 5)
    one = last.groupBy("phrase").agg(F.min("entity").alias("entity"), F.count_distinct("entity").alias("n")).filter("n = 1").select("phrase", "entity", F.lit(True).alias("is_surname"))
    return whole.unionByName(one.join(whole, "phrase", "left_anti"))


def ambiguous_surnames(entities: DataFrame, ambiguous: list[str]) -> DataFrame:
    """ENT-1: (phrase, entity) of surnames that one entity has but that are too common to stand alone."""
    last = entities.select("entity", F.element_at(F.split(normalize(F.col("name")), " "), -1).alias("phrase")).filter(F.col("phrase").isin(*ambiguous))
    return last.groupBy("phrase").agg(F.min("entity").alias("entity"), F.count_distinct("entity").alias("n")).filter("n = 1").drop("n")


def phrase_hits(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """texts' ids with every occurrence of a phrase: id, pos (word), and the dictionary's columns.

    A word goes with as many after it as the longest phrase has - however long; it meets the first words of phrases in an
    equi-join, and only there what follows is held against the rest.  A text is never held against the whole dictionary."""
    longest = dictionary.agg(F.max(F.size(F.split("phrase", " ")))).first()[0]
    if longest is None:
        return texts.select("id", F.lit(0).alias("pos")).join(dictionary, F.lit(False))
    words = texts.select("id", F.split(normalize(F.col("text")), " ").alias("w"))
    after = [f"w{k}" for k in range(longest)]
    runs = F.arrays_zip(*(F.slice("w", k + 1, F.size("w")).alias(name) for k, name in enumerate(after)))
    each = words.select("id", F.posexplode(runs).alias("at", "r")).select("id", (F.col("at") + 1).alias("pos"), "r.*")
    phrases = dictionary.withColumns({"w0": F.substring_index("phrase", " ", 1), "size__": F.size(F.split("phrase", " "))})
    run = F.array_join(F.slice(F.array(*after), F.lit(1), F.col("size__")), " ")
    return each.join(phrases, "w0").filter((F.col("size__") == 1) | (run == F.col("phrase"))).select("id", "pos", *dictionary.columns)


def find_entities(texts: DataFrame, dictionary: DataFrame, most: int | None = 8) -> DataFrame:
    """ENT-2: (id, entities) by first position; a surname counts where the name itself isn't found."""
    surname = F.col("is_surname") if "is_surname" in dictionary.columns else F.lit(False)
    hits = phrase_hits(texts, dictionary.select("phrase", "entity", surname.alias("is_surname")))
    first = hits.groupBy("id", "entity").agg(F.coalesce(F.min(F.when(~F.col("is_surname"), F.col("pos"))), F.min("pos")).alias("pos"))
    ranked = F.transform(F.array_sort(F.collect_list(F.struct("pos", "entity"))), lambda x: x["entity"])
    return first.groupBy("id").agg((F.slice(ranked, 1, most) if most is not None else ranked).alias("entities"))


#: Series of events that are called by their name alone.
SERIES = ["Noche UFC", "UFC Fight Night", "Dana White's Contender Series", "The Ultimate Fighter", "Power Slap"]


def find_events(text: Column) -> Column:
    """ENT-3: event names by pattern: numbered ones, series, and cards named by channel or place, four at most."""
    every = lambda pattern, name: F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), name)
    cased = lambda n: F.when(F.length(n) <= 4, F.upper(n)).otherwise(F.initcap(n))
    number = every(r"(?i)\bufc\s*(\d{2,4})\b", lambda n: F.concat(F.lit("UFC "), n))
    channel = every(r"(?i)\bufc\s+on\s+(espn\+?|abc|fox|fx)(?!\w)", lambda n: F.concat(F.lit("UFC on "), cased(F.replace(n, F.lit("+"), F.lit("")))))
    place = every(r"(?i)\bufc\s+((?:vegas|apex)\s+\d{1,3})\b", lambda n: F.concat(F.lit("UFC "), cased(F.substring_index(n, " ", 1)), F.lit(" "), F.substring_index(n, " ", -1)))
    series = F.array_compact(F.array(*(F.when(text.rlike(words_pattern([n])), F.lit(n)) for n in SERIES)))
    return F.slice(F.array_distinct(F.concat(number, F.filter(series, lambda n: n.isin(SERIES[:2])), channel, place, F.filter(series, lambda n: ~n.isin(SERIES[:2])))), 1, 4)


def event_mentions(texts: DataFrame, events: DataFrame, most: int = 4) -> DataFrame:
    """ENT-3: (id, events): names by pattern, then the known events (event, name, short_name) that a text
    names in whole words, by first position."""
    named = events.select(F.col("name").alias("entity"), F.explode(F.array("name", "short_name")).alias("raw")).select("entity", normalize(F.col("raw")).alias("phrase")).filter(F.length("phrase") >= 5)
    known = find_entities(texts, named.groupBy("phrase").agg(F.min("entity").alias("entity")), most=None)
    rows = texts.select("id", find_events(F.col("text")).alias("by_pattern")).join(known, "id", "left")
    every = F.array_distinct(F.concat("by_pattern", F.coalesce("entities", F.array().cast("array<string>"))))
    return rows.select("id", F.slice(every, 1, most).alias("events"))


#: Words between two names that say that they meet.
AGAINST = ["vs", "vs.", "versus"]


def _sides(text: Column) -> Column:
    """(a, b) of every "A vs B": the text is cut at the words between, and of each two neighbouring pieces the
    capitalised words that end the first and begin the second are the names.  What has been the second name
    of a pair isn't the first of another."""
    name = run_of(NAME_PART, 4)
    pieces = F.split(text, rf"\s+(?:{'|'.join(re.escape(w) for w in reversed(AGAINST))})\s+")
    start = F.struct(F.element_at(pieces, 1).alias("left"), F.array().cast("array<struct<a:string,b:string>>").alias("pairs"))

    def step(held: Column, piece: Column) -> Column:
        first, second = F.regexp_extract(held["left"], rf"({name})$", 1), F.regexp_extract(piece, rf"^({name})", 1)
        met = (first != "") & (second != "")
        rest = F.when(met, F.substr(piece, F.length(second) + 1)).otherwise(piece)
        pair = F.array(F.struct(first.alias("a"), second.alias("b")))
        return F.struct(rest.alias("left"), F.when(met, F.concat(held["pairs"], pair)).otherwise(held["pairs"]).alias("pairs"))

    return F.when(F.size(pieces) > 1, F.aggregate(F.slice(pieces, 2, F.size(pieces)), start, step)["pairs"]).otherwise(start["pairs"])


def find_matchups(text: Column) -> Column:
    """ENT-4, without a dictionary: unordered pairs "A vs B", four at most."""
    keys = F.transform(_sides(text), lambda s: F.array_join(F.array_sort(F.array(normalize(s["a"]), normalize(s["b"]))), "|"))
    return F.slice(F.array_distinct(keys), 1, 4)


def resolve_names(names: DataFrame, dictionary: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """names (key columns, raw) with sure (the known entity, else a plausible name as written) and loose (an
    entity by its ambiguous surname).  Whole names count before surnames, and these before names that
    further words stand before."""
    words = F.split(normalize(F.col("raw")), " ")
    keyed = names.withColumn("w", words).withColumn("k", F.explode(F.sequence(F.lit(0), F.size("w"))))
    # 0 the whole name, 1 the last word, then what is left without the first words
    phrase = F.when(F.col("k") == 0, F.array_join("w", " ")).when(F.col("k") == 1, F.element_at("w", -1)).otherwise(F.array_join(F.slice("w", F.col("k"), F.size("w")), " "))
    tries = keyed.withColumn("phrase", phrase)
    on = names.columns
    known = dictionary.select("phrase", "entity", F.coalesce("is_surname", F.lit(False)).alias("is_surname"))
    hits = tries.join(known, "phrase").filter("(k = 1) = is_surname or size(w) = 1 and k = 0 and not is_surname").groupBy(*on).agg(F.min_by("entity", F.struct("k", "entity")).alias("known"))
    loose = tries.filter("k = 1").join(ambiguous.select("phrase", "entity"), "phrase").groupBy(*on).agg(F.min("entity").alias("loose"))
    bare = F.trim(F.regexp_replace("raw", r"^[ .,:;-]+|[ .,:;-]+$", ""))
    plausible = F.when(F.size("w") .between(2, 4) & F.forall("w", lambda x: F.length(x) > 1), F.initcap(bare))
    rows = names.withColumn("w", words).join(hits, on, "left").join(loose, on, "left")
    return rows.withColumn("sure", F.coalesce("known", plausible)).drop("w", "known")


def matchups(texts: DataFrame, dictionary: DataFrame, ambiguous: DataFrame, most: int = 4) -> DataFrame:
    """ENT-4: (id, matchups as "A vs. B") with both sides as the dictionary calls them; an ambiguous surname
    counts beside a name that is sure; unordered pairs once, in order."""
    pairs = texts.select("id", F.posexplode(_sides(F.col("text"))).alias("place", "s"))
    sides = pairs.select("id", "place", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("s.a").alias("raw")), F.struct(F.lit(1).alias("side"), F.col("s.b").alias("raw")))).alias("x")).select("id", "place", "x.*")
    named = resolve_names(sides, dictionary, ambiguous).groupBy("id", "place").pivot("side", [0, 1]).agg(F.first("sure").alias("sure"), F.first("loose").alias("loose"))
    left, right = F.coalesce("0_sure", F.when(F.col("1_sure").isNotNull(), F.col("0_loose"))), F.coalesce("1_sure", F.when(F.col("0_sure").isNotNull(), F.col("1_loose")))
    both = named.select("id", "place", left.alias("l"), right.alias("r")).filter(normalize(F.col("l")) != normalize(F.col("r")))
    once = both.groupBy("id", F.array_sort(F.array("l", "r")).alias("pair")).agg(F.min(F.struct("place", "l", "r")).alias("f"))
    label = F.transform(F.array_sort(F.collect_list("f")), lambda f: F.concat(f["l"], F.lit(" vs. "), f["r"]))
    return once.groupBy("id").agg(F.slice(label, 1, most).alias("matchups"))


def looks_like_person(name: Column, not_people: list[str]) -> Column:
    """ENT-5"""
    words = F.split(normalize(name), " ")
    return F.size(words).between(2, 4) & ~F.arrays_overlap(words, F.array(*map(F.lit, not_people)))


def weight_classes(text: Column) -> Column:
    """ENT-6"""
    return F.filter(F.array(*map(F.lit, WEIGHT_CLASSES)), lambda w: text.contains(F.replace(w, F.lit("-"), F.lit(" "))))


def mention_counts(found: DataFrame) -> DataFrame:
    """ENT-7: from (id, at, entities), each entity's mentions; derived anew, so running twice is harmless."""
    return found.select("id", "at", F.explode("entities").alias("entity")).groupBy("entity").agg(F.count_distinct("id").alias("mentions"), F.max("at").alias("last_mentioned"))


def merge_entity_rows(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """ENT-8: entities (entity, name, aliases, mentions, last_mentioned) after merges (loser, keeper): aliases
    are united with the losers' names, mentions added up."""
    rows = entities.join(merges.select(F.col("loser").alias("entity"), "keeper"), "entity", "left")
    own = F.col("keeper").isNull()
    names = F.when(own, F.coalesce("aliases", F.array().cast("array<string>"))).otherwise(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    flat = rows.select(F.coalesce("keeper", "entity").alias("entity"), F.when(own, F.col("name")).alias("own_name"), names.alias("names"), "mentions", "last_mentioned")
    counts = flat.groupBy("entity").agg(F.max("own_name").alias("name"), F.sum("mentions").alias("mentions"), F.max("last_mentioned").alias("last_mentioned"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("aliases"))
    return counts.select("entity", "name", F.array_remove("aliases", F.col("name")).alias("aliases"), "mentions", "last_mentioned")


def merge_entities(facts: DataFrame, merges: DataFrame, key: str = "entity") -> DataFrame:
    """ENT-8: facts with merged entities replaced by what they were merged into."""
    return facts.join(merges.select(F.col("loser").alias(key), "keeper"), key, "left").withColumn(key, F.coalesce("keeper", key)).drop("keeper")


def suffixes(domain: Column) -> Column:
    parts = F.split(domain, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def classify_domains(rows: DataFrame, classes: DataFrame, domain: str = "domain") -> DataFrame:
    """JOIN-1: rows with the class of their domain or of its nearest classified parent.

    Each distinct domain walks up once, so a busy domain costs one row."""
    names = rows.select(F.col(domain).alias("d")).filter("d <> ''").distinct()
    walked = names.select("d", F.posexplode(suffixes(F.col("d"))).alias("depth", "suffix"))
    best = walked.join(classes, F.col("suffix") == classes["normalized_id"]).groupBy("d").agg(F.min_by(F.struct("classification", "reliability_weight", "independence_group"), "depth").alias("c"))
    best = best.select(F.col("d").alias(domain), "c.*")
    return rows.join(best, domain, "left")


def upgrade_by_author(rows: DataFrame, authors: DataFrame) -> DataFrame:
    """JOIN-2: a byline's class counts only where it weighs more, its type only over unknown and fan labels."""
    byline = F.trim(F.regexp_replace(F.col("author"), r"(,|\||\s-\s|\sfor\s).*$", ""))
    keyed = rows.withColumn("author_n", normalize(byline))
    a = authors.select(F.col("normalized_id").alias("author_n"), F.col("classification").alias("a_type"), F.col("reliability_weight").alias("a_weight"))
    out = keyed.join(a, "author_n", "left")
    better = F.col("a_weight") > F.coalesce("reliability_weight", F.lit(0.0))
    kind = F.when(better & F.coalesce("source_type", F.lit("UNKNOWN")).isin("UNKNOWN", "FAN_ACCOUNT"), F.col("a_type")).otherwise(F.col("source_type"))
    return out.withColumns({"source_type": kind, "reliability_weight": F.when(better, F.col("a_weight")).otherwise(F.col("reliability_weight"))}).drop("author_n", "a_type", "a_weight")


def related(items: DataFrame, entities: str = "entities", most: int = 6, shared: int = 4) -> DataFrame:
    """JOIN-9: (id, related) - other items that share one of the first entities, the newest first.

    An entity's items are cut to the newest most + 1 before the join: only these can be shown, so a
    busy entity costs a bounded number of rows for each of its items."""
    keys = items.select("id", "at", F.explode(F.slice(entities, 1, shared)).alias("e")).distinct()
    newest = Window.partitionBy("e").orderBy(F.col("at").desc(), F.col("id").desc())
    shown = keys.withColumn("r", F.row_number().over(newest)).filter(F.col("r") <= most + 1).select("e", F.col("id").alias("other"), F.col("at").alias("other_at"))
    pairs = keys.join(shown, "e").filter("id <> other").select("id", "other", "other_at").distinct()
    order = Window.partitionBy("id").orderBy(F.col("other_at").desc(), F.col("other").desc())
    return pairs.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "other"))), lambda x: x["other"]).alias("related"))


def watched(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """JOIN-11: (id, hits) - active watch-list terms in each text, of any length, by word runs."""
    dictionary = terms.select(normalize(F.col("term")).alias("phrase"), F.col("term").alias("entity")).filter("phrase <> ''").distinct()
    return find_entities(texts, dictionary, most=None).select("id", F.size("entities").alias("hits"), "entities")


def account_types(rows: DataFrame, accounts: DataFrame, classes: DataFrame, username: str = "username") -> DataFrame:
    """JOIN-3: rows with account_type: that of the monitored accounts (username, account_type), else of the
    classifications (kind, normalized_id, classification), else UNKNOWN."""
    handle = lambda c: F.lower(F.regexp_replace(F.trim(c), "^@+", ""))
    a = accounts.select(handle(F.col("username")).alias("handle__"), F.col("account_type").alias("a__")).dropDuplicates(["handle__"])
    c = classes.filter("kind = 'x_account'").select(F.col("normalized_id").alias("handle__"), F.col("classification").alias("c__")).dropDuplicates(["handle__"])
    keyed = rows.drop("account_type").withColumn("handle__", handle(F.col(username)))
    return keyed.join(a, "handle__", "left").join(c, "handle__", "left").withColumn("account_type", source_type(F.coalesce("a__", "c__"))).drop("handle__", "a__", "c__")


def story_items(members: DataFrame, items: DataFrame, item: str = "id", skip_primary: bool = False) -> DataFrame:
    """JOIN-4: what belongs to a story, with the columns of both sides (members: story, item, role, similarity);
    without the origin these are its related reports."""
    rows = members.filter("role <> 'origin'") if skip_primary else members
    return rows.join(items, item)


def bouts_of(bouts: DataFrame, names: DataFrame) -> DataFrame:
    """JOIN-12: (name, bout columns) - the bouts whose pair holds the name (names: name)."""
    sides = bouts.withColumn("side__", F.explode(F.array_distinct(F.split("pair_key", r"\|"))))
    return sides.join(names.select("name", normalize(F.col("name")).alias("side__")), "side__").drop("side__")


def entity_listing(entities: DataFrame, order: str = "name") -> DataFrame:
    """WIN-8: entities by name, by mentions, or by when they were last mentioned, those never last."""
    by = {"name": [], "mentions": [F.col("mentions").desc_nulls_last()], "recent": [F.col("last_mentioned").desc_nulls_last()]}[order]
    return entities.orderBy(*by, "name")
