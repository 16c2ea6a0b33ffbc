"""Events that turn out to be one, with all that hangs on them (RES-2, 3, JOIN-8), and corrections by hand (RES-15)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse
from .classify import source_type
from .matching import first_by
from .resolve import _matchup, follow_redirects, strip_sponsors

#: How far the origin of a name is trusted; others count 1.
ORIGINS = {"collected": 3, "official": 3, "user": 2}


def name_rank(name: Column, origin: Column) -> Column:
    """RES-3: of several names the largest is shown: a firm origin, then one that says who meets, then the longer."""
    trust = F.coalesce(*(F.when(origin == k, F.lit(v)) for k, v in ORIGINS.items()), F.lit(1))
    text = F.coalesce(name, F.lit(""))
    says = _matchup(F.split(collapse(strip_sponsors(text)), " ")).isNotNull().cast("int")
    return F.struct(trust.alias("trust"), says.alias("says"), F.length(text).alias("length"))


def better_name(rows: DataFrame, key: str, origin: str = "data_origin") -> DataFrame:
    """RES-3: (key, name): the best name among the rows of each key; equal ones by the name itself."""
    return rows.groupBy(key).agg(F.max_by("name", F.struct(name_rank(F.col("name"), F.col(origin)).alias("r"), "name")).alias("name"))


def merge_mapping(events: DataFrame) -> DataFrame:
    """RES-2: (loser, keeper, place): live events (event, key, name, data_origin, merged_into) with the key of a better
    named or older one.  place orders the losers of a keeper as they are taken in."""
    live = events.filter(F.col("merged_into").isNull()).withColumn("rank", F.struct(name_rank(F.col("name"), F.col("data_origin")).alias("r"), (-F.col("event")).alias("e")))
    best = live.groupBy("key").agg(F.max_by("event", "rank").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return live.join(best, "key").filter("event <> keeper").select(F.col("event").alias("loser"), "keeper", F.col("rank").alias("place"))


def repoint(rows: DataFrame, mapping: DataFrame, column: str = "event") -> DataFrame:
    """Children of merged events at their keepers."""
    to = mapping.select(F.col("loser").alias(column), "keeper")
    return rows.join(to, column, "left").withColumn(column, F.coalesce("keeper", column)).select(*rows.columns)


def merge_events(events: DataFrame, bouts: DataFrame, aliases: DataFrame, keep, fill: list[str], sums: list[str], maxes: list[str]) -> dict[str, DataFrame]:
    """RES-2: the tables `events`, `bouts`, `aliases` and `redirects` after events with one key have become one.

    events: event, key, name, data_origin, merged_into and the columns to fill, add up and maximise.  A keeper's gaps are filled
    from the losers in their order, never overwritten.  bouts: id, event, pair_key and more; of two for one
    pair the keeper's own stays, else that of the loser taken in first.  aliases: alias_key, event; a keeper's own claim stays.
    redirects: id, target: losers, and what was merged before, at the event where they end now."""
    mapping = keep(merge_mapping(events))
    live = events.filter(F.col("merged_into").isNull())
    placed = live.join(mapping.select(F.col("loser").alias("event"), "keeper", "place"), "event", "left").withColumn("id__", F.coalesce("keeper", "event"))
    # the keeper itself, which has no place, comes before all losers; the best loser comes first
    order = F.struct(F.col("place").isNull().cast("int").alias("own"), "place")
    first = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ["key", "name", "data_origin", *fill]]
    merged = placed.groupBy(F.col("id__").alias("event")).agg(*first, *(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in maxes), (F.count(F.lit(1)) - 1).alias("merged"))

    def moved(rows: DataFrame) -> DataFrame:
        return rows.join(mapping.withColumnRenamed("loser", "event"), "event", "left")

    own = F.col("keeper").isNull()
    better = F.col("place.r")
    rank = [F.when(own, 0).otherwise(1), -better["trust"], -better["says"], -better["length"], -F.col("place.e")]
    to = F.coalesce("keeper", "event")
    cards = first_by(moved(bouts).select(*(c for c in bouts.columns if c != "event"), to.alias("event"), *(r.alias(f"o{k}__") for k, r in enumerate(rank))), ["event", "pair_key"], [*(F.col(f"o{k}__") for k in range(len(rank))), F.col("id")])
    named = moved(aliases).groupBy("alias_key").agg(F.min_by(to, F.struct(F.when(own, 0).otherwise(1), to)).alias("event"))
    old = events.filter(F.col("merged_into").isNotNull()).select(F.col("event").alias("id"), F.col("merged_into").alias("target"))
    redirects = follow_redirects(old.unionByName(mapping.select(F.col("loser").alias("id"), F.col("keeper").alias("target"))), keep)
    return {"events": merged, "bouts": cards.select(*bouts.columns), "aliases": named, "redirects": redirects}


def live_aliases(aliases: DataFrame, tombstones: DataFrame) -> DataFrame:
    """JOIN-8: aliases (alias_key, event) without those of merged events (event): a redirect is no identity."""
    return aliases.join(tombstones.select("event").distinct(), "event", "left_anti")


#: Places that the corrections of one value are dealt to.
SALTS = 64
AUDIT = ["id", "kind", "target", "before", "after", "reason", "at"]


def apply_corrections(stories: DataFrame, sources: DataFrame, links: DataFrame, corrections: DataFrame, events: DataFrame, categories: list[str]) -> dict[str, DataFrame]:
    """RES-15: `stories`, `sources` and `links` as corrected, the `audit` of what was done and the `rejected` rest.

    stories: story, event, category; sources: source, source_type, reliability; links: story, article.
    corrections: id, kind, target, value, weight, reason, at, of four kinds:

    * reassign_event: a story's event, which must exist; null takes it away
    * recategorise: a story's category, one of the valid ones
    * reclassify: a source's type, in any spelling, and its reliability (weight) between 0 and 1; null leaves it
    * detach: an article (value) leaves a story

    Corrections count in the order of (at, id), those with one id by value and weight; each is told with the value that
    it found and the one that it left.
    One that can't be applied changes nothing and is told with the reason.  Corrections of one target are
    few, as people make them, so a window orders them."""
    c = corrections.withColumn("value", F.trim("value"))
    of = lambda kind: c.filter(F.col("kind") == kind)
    number = F.col("value").try_cast("long")
    no_target, none = F.lit("no such target"), F.lit(None).cast("string")

    def checked(rows: DataFrame, table: DataFrame, key: str, before: Column, after: Column, wrong: Column) -> DataFrame:
        known = table.select(F.col(key).alias("target"), before.alias("before"), F.lit(True).alias("known"))
        found = rows.join(known, "target", "left")
        return found.withColumns({"error": F.when(F.col("known").isNull(), no_target).otherwise(wrong), "after": after})

    exists = events.select(F.col("event").cast("string").alias("value"), F.lit(True).alias("exists")).distinct()
    named = of("reassign_event").withColumn("value", F.when(F.col("value").isNotNull(), F.coalesce(number.cast("string"), F.col("value"))))
    # many corrections name one event, or none: those that name any are dealt by value and place
    place = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    asked = named.filter(F.col("value").isNotNull()).withColumn("place", place)
    there = asked.select("value", "place").distinct().join(exists, "value").select("value", "place", "exists")
    named = asked.join(there, ["value", "place"], "left").drop("place").unionByName(named.filter(F.col("value").isNull()).withColumn("exists", F.lit(None).cast("boolean")))
    moved = checked(named, stories, "story", F.col("event").cast("string"), F.col("value"), F.when(F.col("value").isNotNull() & F.col("exists").isNull(), F.lit("no such event")))
    filed = checked(of("recategorise"), stories, "story", F.col("category"), F.col("value"), F.when(~F.coalesce(F.col("value").isin(categories), F.lit(False)), F.lit("no such category")))
    weight = F.when(F.col("weight").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("weight"))))
    typed = checked(of("reclassify"), sources, "source", F.concat_ws("|", "source_type", F.col("reliability").cast("string")), source_type(F.col("value")), F.when(F.col("value").isNull(), F.lit("no type")))
    pair = links.select(F.col("story").alias("target"), F.col("article").cast("string").alias("value"), F.lit(True).alias("linked")).distinct()
    cut = of("detach").join(pair, ["target", "value"], "left").withColumns({"before": F.col("value"), "after": none, "error": F.when(F.col("linked").isNull(), F.lit("no such link"))})
    columns = ["id", "kind", "target", "value", "before", "after", "weight", "reason", "at", "error"]
    every = reduce(lambda a, b: a.unionByName(b), (x.select(*columns) for x in (moved, filed, typed, cut)))
    unknown = c.filter(~F.coalesce(F.col("kind").isin("reassign_event", "recategorise", "reclassify", "detach"), F.lit(False))).select("id", "kind", "target", F.lit("no such kind").alias("error"))
    good = every.filter(F.col("error").isNull())
    # an article leaves a story once; a second time there is no link left
    order = ["at", "id", "value", "weight"]
    again = F.row_number().over(Window.partitionBy("kind", "target", "before").orderBy(*order))
    good = good.withColumn("again", F.when(F.col("kind") == "detach", again).otherwise(1))
    repeated = good.filter("again > 1").select("id", "kind", "target", F.lit("no such link").alias("error"))
    good = good.filter("again = 1")
    # a source keeps its reliability where a correction gives none
    steps = Window.partitionBy("kind", "target").orderBy(*order)
    so_far = steps.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.coalesce(F.last(weight, ignorenulls=True).over(so_far), F.substring_index("before", "|", -1).try_cast("double"))
    good = good.withColumn("after", F.when(F.col("kind") == "reclassify", F.concat_ws("|", "after", held.cast("string"))).otherwise(F.col("after")))
    first = F.row_number().over(steps) == 1
    audit = good.withColumn("before", F.when(first | (F.col("kind") == "detach"), F.col("before")).otherwise(F.lag("after").over(steps)))
    last = good.filter("kind <> 'detach'").groupBy("kind", "target").agg(F.max_by(F.struct("after"), F.struct(*order)).alias("l"))
    fix = lambda kind, key: last.filter(F.col("kind") == kind).select(F.col("target").alias(key), F.col("l.after").alias("fixed"), F.lit(True).alias("hit"))
    hit = F.col("hit").isNotNull()
    done = stories.join(fix("reassign_event", "story"), "story", "left").withColumn("event", F.when(hit, F.col("fixed").try_cast(stories.schema["event"].dataType)).otherwise(F.col("event"))).drop("fixed", "hit")
    done = done.join(fix("recategorise", "story"), "story", "left").withColumn("category", F.coalesce("fixed", "category")).drop("fixed", "hit")
    kept = sources.join(fix("reclassify", "source"), "source", "left")
    kept = kept.withColumns({"source_type": F.when(hit, F.substring_index("fixed", "|", 1)).otherwise(F.col("source_type")), "reliability": F.when(hit, F.substring_index("fixed", "|", -1).try_cast("double")).otherwise(F.col("reliability"))})
    gone = good.filter("kind = 'detach'").select(F.col("target").alias("story"), F.col("before").try_cast(links.schema["article"].dataType).alias("article"))
    rejected = every.filter(F.col("error").isNotNull()).select("id", "kind", "target", "error").unionByName(unknown).unionByName(repeated)
    return {"stories": done.select(*stories.columns), "sources": kept.select(*sources.columns), "links": links.join(gone, ["story", "article"], "left_anti"), "audit": audit.select(*AUDIT), "rejected": rejected}
