"""Duplicates, similarity and story clusters (DUP-*, JOIN-6, JOIN-7, CLU-*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.text import clean_title, normalize, normalize_title, overlap, title_similarity, token_set, tokens, truncate
from ..functions.url import url_hash
from . import likeness
from .posts import BEST, best_stories

CONFIG = EngineConfig()
#: Groups of keys of a stretch in which posts meet stories; a task holds one at a time.
BUCKETS = 64
#: Developments that never share a story.
DISTINCT = ["fight_announcement", "injury", "cancellation", "replacement", "result", "retirement", "suspension", "ranking"]


def first_by(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in order.  A struct minimum combines before the shuffle, where a
    window would carry every row to its key."""
    rest = [c for c in rows.columns if c not in key]
    best = F.min_by(F.struct(*rest), F.struct(*order)) if rest else F.lit(1)
    out = rows.groupBy(*key).agg(best.alias("best__"))
    return out.select(*key, *(F.col(f"best__.`{c}`").alias(c) for c in rest)).select(*rows.columns)


def insert_if_absent(new: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """SNK-1, DUP-1: articles whose canonical URL is new, the first collected of each."""
    rows = new.filter(F.col("url").isNotNull() & (F.trim("title") != "")).withColumn("url_hash", url_hash(F.col("url")))
    rows = first_by(rows, ["url_hash"], [F.col("collected_at"), F.col("url"), F.col("title")])
    return rows.join(store.select("url_hash"), "url_hash", "left_anti") if store is not None else rows


def grams_of(docs: DataFrame, stop: bool = True) -> DataFrame:
    """(id, copies, grams): the one- and two-word grams of every text that has any, repeats included."""
    words = tokens(normalize(F.col("text"))) if stop else F.split(normalize(F.col("text")), " ")
    copies = F.col("copies") if "copies" in docs.columns else F.lit(1)
    base = docs.select("id", words.alias("w"), copies.alias("copies")).filter(F.size("w") > 0)
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda x, y: F.concat_ws(" ", x, y))).otherwise(F.array().cast("array<string>"))
    return base.select("id", "copies", F.concat("w", pairs).alias("grams"))


def tfidf(docs: DataFrame, stop: bool = True) -> DataFrame:
    """DUP-2: (id, gram, w) - one- and two-word grams, sublinear counts, smooth idf, unit length.

    A document that stands for several (a column `copies`) counts as so many."""
    base = grams_of(docs, stop)
    tf = base.select("id", "copies", F.explode("grams").alias("gram")).groupBy("id", "copies", "gram").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("gram").agg(F.sum("copies").alias("df"))
    n = base.agg(F.sum("copies").alias("n"))
    weighted = tf.join(df, "gram").join(F.broadcast(n)).withColumn("raw", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return weighted.join(norm, "id").select("id", "gram", (F.col("raw") / F.col("norm")).alias("w"), "df")


def blocked_pairs(keys: DataFrame, hours: int | None = None) -> DataFrame:
    """(a, b), a < b, of ids that share a key; with hours, only of those (id, key, at) that are no further apart.

    A key that many hold is no quadratic block: items meet by key and by stretches of that many hours,
    each with its own and the two beside it, so what a key costs follows from how much happens at a time."""
    if hours is None:
        return keys.select("key", F.col("id").alias("a")).join(keys.select("key", F.col("id").alias("b")), "key").filter("a < b").select("a", "b").distinct()
    band = F.floor(F.unix_seconds("at") / (hours * 3600))
    left = keys.select("key", band.alias("band"), F.col("id").alias("a"), F.col("at").alias("ta"))
    right = keys.select("key", F.explode(F.array(band - 1, band, band + 1)).alias("band"), F.col("id").alias("b"), F.col("at").alias("tb"))
    near = (F.col("a") < F.col("b")) & (F.abs(F.unix_micros("ta") - F.unix_micros("tb")) <= hours * 3_600_000_000)
    return left.join(right, ["key", "band"]).filter(near).select("a", "b").distinct()


def prefix_keys(weights: DataFrame, least: float) -> DataFrame:
    """(id, key): the rarest grams of each document, up to where the rest is too light for a cosine of `least`.

    Unit vectors with such a cosine share one of these, so common grams drop out and no pair does.
    Grams are in one order, by how many documents have them; the window is over one document."""
    order = Window.partitionBy("id").orderBy("df", "gram").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rest = weights.withColumn("rest", F.sum(F.col("w") * F.col("w")).over(order))
    return rest.filter(F.col("rest") >= least * least - 1e-9).select("id", F.col("gram").alias("key"))


def rare_tokens(rows: DataFrame, share: float) -> DataFrame:
    """(id, key, n): of rows (id, tokens), the rarest n - ceil(share n) + 1 of n tokens; sets that share that
    part of one of them share one of its keys."""
    each = rows.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("key"))
    df = each.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "key"))
    return each.join(df.hint("merge"), "key").withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(share * F.col("n")) + 1).select("id", "key", "n")


def fold_equal(rows: DataFrame, key: Column, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(members, sizes): every row's (id, rep) with the smallest id of the rows whose key is equal, and (rep, copies).

    What is equal needs no pairs: a class of any size is a row for each member.  Rows without a key stand for themselves."""
    keyed = rows.select(F.col(id_col).alias("id"), F.sha2(key, 256).alias("k"))
    reps = keyed.filter("k is not null").groupBy("k").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    members = keyed.join(reps.select("k", "rep"), "k", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    alone = keyed.filter("k is null").select(F.col("id").alias("rep"), F.lit(1).cast("long").alias("copies"))
    return members, reps.select("rep", "copies").unionByName(alone)


def _banded(keys: DataFrame, hours: int) -> tuple[DataFrame, DataFrame]:
    """Rows with `at` by their stretch of so many hours, and once more in it and the two beside it."""
    band = F.floor(F.unix_seconds("at") / (hours * 3600))
    return keys.withColumn("band", band), keys.withColumn("band", F.explode(F.array(band - 1, band, band + 1)))


def candidate_pairs(articles: DataFrame, weights: DataFrame, hours: int = CONFIG.match_hours, text: float = CONFIG.reply_text_similarity, times: DataFrame | None = None) -> DataFrame:
    """JOIN-6: (a, b) of articles (id, at, title) near in time that may be alike enough in content or headline.

    times: (id, at) where articles stand for classes that have several times; one of each must be near."""
    at = articles.select("id", "at") if times is None else times
    content = blocked_pairs(prefix_keys(weights, text).join(at, "id"), hours)
    titles = articles.select("id", token_set(normalize_title(F.col("title"))).alias("tokens")).filter(F.size("tokens") > 0)
    # an overlap is a share of the smaller set: its rare tokens meet all tokens of the larger
    few = _banded(rare_tokens(titles, text).join(at, "id"), hours)[0].select("key", "band", F.col("id").alias("x"), F.col("at").alias("tx"), F.col("n").alias("nx"))
    every = titles.join(at, "id").select("id", "at", F.size("tokens").alias("ny"), F.explode("tokens").alias("key"))
    every = _banded(every, hours)[1].select("key", "band", F.col("id").alias("y"), F.col("at").alias("ty"), "ny")
    near = (F.col("nx") <= F.col("ny")) & (F.col("x") != F.col("y")) & (F.abs(F.unix_micros("tx") - F.unix_micros("ty")) <= hours * 3_600_000_000)
    headline = few.join(every, ["key", "band"]).filter(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return content.unionByName(headline).distinct()


def near_pairs(articles: DataFrame, keep, config: EngineConfig = CONFIG, hours: int | None = None, times: DataFrame | None = None) -> DataFrame:
    """JOIN-6: (a, b, content, headline) of all articles (id, at, title, text) near in time that are alike in one of both.

    times: (id, at) where articles stand for classes that have several times; one of each must be near."""
    at = articles.select("id", "at") if times is None else times
    heads = F.transform(token_set(normalize_title(F.col("title"))), lambda w: F.xxhash64(w))
    words = F.array_join(tokens(normalize(F.col("text"))), " ")
    copies = F.col("copies") if "copies" in articles.columns else F.lit(1)
    texts = articles.select("id", copies.cast("long").alias("copies"), words.alias("words"), heads.alias("heads"))
    return likeness.near_texts(texts, at, keep, config.match_hours if hours is None else hours, config.reply_text_similarity)


def cosine(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """(a, b, content) - sparse dot products of the given pairs only."""
    wa, wb = weights.select(F.col("id").alias("a"), "gram", F.col("w").alias("wa")), weights.select(F.col("id").alias("b"), "gram", F.col("w").alias("wb"))
    dots = pairs.join(wa, "a").join(wb, ["b", "gram"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("content"))
    return pairs.join(dots, ["a", "b"], "left").select("a", "b", F.coalesce("content", F.lit(0.0)).alias("content"))


FEATURES = ["title", "entities", "events", "category", "has_denial"]


def liken(pairs: DataFrame, articles: DataFrame) -> DataFrame:
    """What JOIN-6 asks of two articles but for their times, added to (a, b, content) or (a, b, content, headline)."""
    known = "headline" in pairs.columns
    side = lambda k: articles.select(F.col("id").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in FEATURES if c != "title" or not known))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    return rows.withColumns(
        {
            "people": overlap(F.col("entities_a"), F.col("entities_b")),
            "event": overlap(F.col("events_a"), F.col("events_b")),
            "headline": F.col("headline") if known else title_similarity(F.col("title_a"), F.col("title_b")),
            "both": (F.size("entities_a") > 0) & (F.size("entities_b") > 0),
            "named": (F.size("entities_a") + F.size("entities_b") + F.size("events_a") + F.size("events_b")) > 0,
            "differ": (F.col("category_a") != F.col("category_b")) & F.col("category_a").isin(DISTINCT) & F.col("category_b").isin(DISTINCT),
        }
    )


def match_score(gap: Column, config: EngineConfig = CONFIG) -> Column:
    """JOIN-6: the score of likened articles so many hours apart; it only falls as the gap grows."""
    entity, recency = F.greatest("people", "event"), F.greatest(F.lit(0.0), 1 - gap / config.match_hours)
    return F.when(F.col("named"), 0.34 * F.col("content") + 0.28 * F.col("headline") + 0.24 * entity + 0.14 * recency).otherwise(0.48 * F.col("content") + 0.38 * F.col("headline") + 0.14 * recency)


def match_accepted(score: Column, gap: Column, denies: Column, config: EngineConfig = CONFIG) -> Column:
    """JOIN-6's gates; what holds at a gap holds at any smaller one.  A denial answers what came before it."""
    entity, text = F.greatest("people", "event"), F.greatest("content", "headline")
    reply = denies & (gap <= 24) & ((F.col("people") > 0) | (F.col("event") > 0))
    gates = (gap <= config.match_hours) & ~(F.col("both") & (F.col("people") == 0)) & ~(F.col("differ") & ~reply)
    by_score = (score >= config.similarity) & (text >= config.text_similarity)
    by_headline = (F.col("headline") >= config.title_similarity) & ((entity > 0) | ~F.col("named"))
    return gates & (by_score | by_headline | (reply & (entity >= 0.5) & (text >= config.reply_text_similarity)))


def score_pairs(pairs: DataFrame, articles: DataFrame, config: EngineConfig = CONFIG) -> DataFrame:
    """JOIN-6: (a, b, content) with gates and score."""
    at = lambda k: articles.select(F.col("id").alias(k), F.col("at").alias(f"at_{k}"))
    rows = liken(pairs, articles).join(at("a"), "a").join(at("b"), "b")
    rows = rows.withColumn("gap", F.abs(F.unix_micros("at_b") - F.unix_micros("at_a")) / 3.6e9)
    denies = F.when(F.col("at_b") >= F.col("at_a"), F.col("has_denial_b")).otherwise(F.col("has_denial_a"))
    rows = rows.withColumn("score", match_score(F.col("gap"), config))
    return rows.withColumn("accepted", match_accepted(F.col("score"), F.col("gap"), denies, config))


def _latest_before(directed: DataFrame, members: DataFrame, hours: int) -> DataFrame:
    """Of directed classes (child, parent, ..): for each member of the child the parent's latest member before it,
    no more than about so many hours back: (id, at, p_id, p_at, ..).

    An as-of join: rows of both classes meet by pair and stretch of time, in order, so a class costs
    what it holds, not its square.  Of members at one time the smallest id counts."""
    width = hours * 3600
    band = F.floor(F.unix_seconds("at") / width).alias("band")
    times = members.groupBy("rep", "at").agg(F.min("id").alias("first")).select("rep", "at", "first", band)
    # a stretch begins with the last member of the one before
    carried = times.groupBy("rep", "band").agg(F.max(F.struct("at", "first")).alias("l")).select("rep", F.col("l.at").alias("at"), F.col("l.first").alias("first"), (F.col("band") + 1).alias("band"))
    entry = F.struct("at", "first").alias("entry")
    step = Window.partitionBy("rep", "band").orderBy("at")
    entries = times.unionByName(carried).select("rep", "band", "at", entry, F.lag(F.struct("at", "first")).over(step).alias("prior"))
    there = members.select(F.col("rep").alias("child"), band).distinct()
    pairs = directed.select("child", "parent")
    none = F.lit(None)
    kind = "struct<at:timestamp,first:bigint>"
    of_parent = pairs.join(there, "child").join(entries.withColumnRenamed("rep", "parent"), ["parent", "band"]).select("child", "parent", "band", "at", F.lit(0).alias("kind"), none.cast("bigint").alias("id"), "entry", "prior")
    low = F.col("least_score") if "least_score" in members.columns else F.lit(-1.0)
    children = members.select(F.col("rep").alias("child"), "id", "at", band, low.alias("least_score"))
    best = directed.select("child", "parent", "most")
    of_child = best.join(children, "child").filter(F.col("most") >= F.col("least_score"))
    of_child = of_child.select("child", "parent", "band", "at", F.lit(1).alias("kind"), "id", none.cast(kind).alias("entry"), none.cast(kind).alias("prior"))
    so_far = Window.partitionBy("child", "parent", "band").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda c: F.last(c, ignorenulls=True).over(so_far)
    met = of_parent.unionByName(of_child).withColumns({"e": last("entry"), "p": last(F.when(F.col("kind") == 0, F.struct("prior")))}).filter("kind = 1")
    same = (F.col("e.at") == F.col("at")) & (F.col("e.first") >= F.col("id"))
    found = met.withColumn("f", F.when(same, F.col("p.prior")).otherwise(F.col("e"))).filter("f is not null")
    return found.select("child", "parent", "id", "at", F.col("f.first").alias("p_id"), F.col("f.at").alias("p_at")).join(directed.drop("most"), ["child", "parent"])


def best_parents(articles: DataFrame, keep, config: EngineConfig = CONFIG) -> DataFrame:
    """CLU-1: (id, parent, similarity): the best accepted earlier article of each.

    Articles that are equal in all but their time are a class, compared with others once.  Within two classes only
    the nearest earlier member can be best, as scores fall with the gap.  Members first look into their own
    class; other classes are looked into only where their best score could be higher."""
    wanted = articles.select("id", "at", "text", *FEATURES)
    members, sizes = fold_equal(wanted, F.to_json(F.struct("text", *FEATURES)))
    members = keep(members.join(wanted.select("id", "at"), "id"))
    classes = keep(wanted.join(sizes.withColumnRenamed("rep", "id"), "id"))
    hour = F.timestamp_seconds(F.floor(F.unix_seconds("at") / 3600) * 3600)
    # a class's times to the hour: candidates may be an hour too far apart, the gap decides below
    times = members.select(F.col("rep").alias("id"), hour.alias("at")).distinct()
    pairs = near_pairs(classes, keep, config, config.match_hours + 1, times)
    # equal texts are alike by 1, and so are their headlines, if they have any words
    some = lambda words: F.when(F.size(words) > 0, 1.0).otherwise(0.0)
    own = classes.filter("copies > 1").select(F.col("id").alias("a"), F.col("id").alias("b"), some(tokens(normalize(F.col("text")))).alias("content"), some(token_set(normalize_title(F.col("title")))).alias("headline"))
    alike = keep(liken(pairs.unionByName(own), classes))
    columns = ["content", "people", "event", "headline", "both", "named", "differ"]
    way = lambda child, parent: alike.select(F.col(child).alias("child"), F.col(parent).alias("parent"), F.col(f"has_denial_{child}").alias("denies"), *columns)
    none = F.lit(0.0)
    directed = way("b", "a").unionByName(way("a", "b").filter("child <> parent"))
    directed = directed.withColumn("most", match_score(none, config)).filter(match_accepted(F.col("most"), none, F.col("denies"), config))
    gap = (F.unix_micros("at") - F.unix_micros("p_at")) / 3.6e9

    def best(rows: DataFrame) -> DataFrame:
        # sums of one value in several orders; beyond twelve digits scores differ by chance
        scored = rows.withColumn("gap", gap).withColumn("score", F.round(match_score(F.col("gap"), config), 12))
        good = scored.filter(match_accepted(F.col("score"), F.col("gap"), F.col("denies"), config))
        return good.groupBy("id").agg(F.max(F.struct("score", (-F.col("p_id")).alias("p"))).alias("m"))

    within = keep(best(_latest_before(directed.filter("child = parent"), members, config.match_hours)))
    known = members.join(within.select("id", F.col("m.score").alias("own")), "id", "left").select("id", "at", "rep", F.coalesce("own", F.lit(-1.0)).alias("least_score"))
    across = best(_latest_before(directed.filter("child <> parent"), known, config.match_hours))
    found = within.unionByName(across).groupBy("id").agg(F.max("m").alias("m"))
    return found.select("id", (-F.col("m.p")).alias("parent"), F.col("m.score").alias("similarity"))


def cluster(articles: DataFrame, scored: DataFrame, checkpoint=None) -> DataFrame:
    """CLU-1 over scored pairs: (id, story, role, similarity)."""
    order = articles.select("id", "at")
    pairs = scored.filter("accepted").select("a", "b", "score")
    ends = pairs.join(order.withColumnsRenamed({"id": "a", "at": "ta"}), "a").join(order.withColumnsRenamed({"id": "b", "at": "tb"}), "b")
    later_b = (F.col("ta") < F.col("tb")) | ((F.col("ta") == F.col("tb")) & (F.col("a") < F.col("b")))
    directed = ends.select(F.when(later_b, F.col("b")).otherwise(F.col("a")).alias("id"), F.when(later_b, F.col("a")).otherwise(F.col("b")).alias("parent"), "score")
    best = directed.groupBy("id").agg(F.max(F.struct("score", (-F.col("parent")).alias("p"))).alias("m")).select("id", (-F.col("m.p")).alias("parent"), F.col("m.score").alias("similarity"))
    return follow_parents(articles, best, checkpoint)


def cluster_articles(articles: DataFrame, keep, config: EngineConfig = CONFIG) -> DataFrame:
    """CLU-1: (id, story, role, similarity) of articles, copies folded before any pair is made."""
    return follow_parents(articles, best_parents(articles, keep, config), keep)


def follow_parents(articles: DataFrame, best: DataFrame, checkpoint=None) -> DataFrame:
    """CLU-1: an article joins its best earlier article's story; stories are the roots, found by pointer doubling."""
    up = articles.select("id").join(best, "id", "left").select("id", F.coalesce("parent", "id").alias("root"), F.coalesce("similarity", F.lit(1.0)).alias("similarity"))
    keep = checkpoint or (lambda df: df.checkpoint())
    while True:
        nxt = up.select(F.col("id").alias("root"), F.col("root").alias("next"))
        jumped = keep(up.join(nxt, "root").select("id", F.col("next").alias("root"), "similarity", (F.col("next") != F.col("root")).alias("moved")))
        done = jumped.filter("moved").isEmpty()
        up = jumped.drop("moved")
        if done:
            break
    role = F.when(F.col("id") == F.col("root"), F.lit("origin")).when(F.col("similarity") > 0.92, "duplicate").otherwise("corroboration")
    return up.select("id", F.col("root").alias("story"), role.alias("role"), "similarity")


def first_values(rows: DataFrame, column: str, most: int) -> DataFrame:
    """(story, column): the first values of a list column over a story's articles, in their order, each once whatever
    its spelling.  Values are one row each until they are ranked, so no story's lists are gathered whole."""
    each = rows.select("story", "at", "id", F.posexplode(column).alias("pos", "value")).withColumn("key", normalize(F.col("value"))).filter("key <> ''")
    once = each.groupBy("story", "key").agg(F.min(F.struct("at", "id", "pos", "value")).alias("f"))
    place = F.row_number().over(Window.partitionBy("story").orderBy("f"))
    first = once.withColumn("place", place).filter(F.col("place") <= most)
    return first.groupBy("story").agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["value"]).alias(column))  # at most `most`


def fold_stories(articles: DataFrame, members: DataFrame, lists: dict[str, int] | None = None) -> DataFrame:
    """CLU-2: a story's row from its origin and members.

    articles: id, at, title, category, entities; and, where they have them, summary, image_url, is_official, events and
    keywords.  The first official article gives headline and summary (the origin's where it has none), the
    first image is the story's; lists are merged in order, 12 names and 20 keywords at most."""
    rows = articles.join(members, "id")
    lists = lists or {c: most for c, most in (("entities", 12), ("events", 12), ("keywords", 20)) if c in articles.columns}
    order = F.struct("at", "id")
    first = lambda c, test=None: F.min_by(c, order if test is None else F.when(test, order))
    official = F.coalesce("is_official", F.lit(False)) if "is_official" in articles.columns else F.lit(False)
    filled = lambda c: F.col(c).isNotNull() & (F.trim(c) != "")
    made = [
        F.coalesce(first("title", official & filled("title")), first("title")).alias("headline"),
        first("category").alias("category"),
        F.min("at").alias("first_seen"),
        F.max("at").alias("last_seen"),
        (F.count(F.lit(1)) - 1).alias("updates"),
    ]
    if "summary" in articles.columns:
        made.append(truncate(F.coalesce(first("summary", official & filled("summary")), first("summary", filled("summary"))), 400).alias("summary"))
    if "image_url" in articles.columns:
        made.append(first("image_url", filled("image_url")).alias("image_url"))
    folded = rows.groupBy("story").agg(*made)
    for column, most in lists.items():
        folded = folded.join(first_values(rows, column, most), "story", "left").withColumn(column, F.coalesce(column, F.array().cast("array<string>")))
    return folded.withColumn("headline", clean_title(F.col("headline")))


def attach_new(new: DataFrame, stored: DataFrame, members: DataFrame, scored: DataFrame, checkpoint=None) -> DataFrame:
    """CLU-3: (id, story, role, similarity) of new articles: they join stored stories (members: id, story) or
    each other's.  stored: the articles of recent stories; what is stored is never moved."""
    fresh = new.select("id").withColumn("fresh", F.lit(True))
    side = lambda k: fresh.withColumnsRenamed({"id": k, "fresh": f"fresh_{k}"})
    pairs = scored.join(side("a"), "a", "left").join(side("b"), "b", "left").filter("fresh_a or fresh_b").drop("fresh_a", "fresh_b")
    columns = ["id", "at"]
    both = new.select(*columns).unionByName(stored.select(*columns))
    # an older new article can't found what a stored one belongs to: stored ones stand first
    ahead = both.join(fresh, "id", "left").select("id", F.when(F.col("fresh"), F.col("at")).otherwise(F.lit("1970-01-01").cast("timestamp")).alias("at"))
    found = cluster(ahead, pairs, checkpoint).join(fresh.select("id"), "id", "left_semi")
    known = members.select(F.col("id").alias("root"), F.col("story").alias("known"))
    rooted = found.withColumnRenamed("story", "root").join(known, "root", "left")
    return rooted.select("id", F.coalesce("known", "root").alias("story"), "role", "similarity")


def duplicate_report(articles: DataFrame, keep, least: float = 0.8) -> DataFrame:
    """DUP-3: (reason, relation, a, b, similarity) of articles (id, url, title, text) with the same canonical URL, or
    headlines or texts that are nearly identical.

    relation "copy": a is equal to the representative b; "near": the representatives a < b are alike.  All copies
    of two that are near are near too, so no link is lost and none is written twice."""
    words_of = F.array_join(tokens(normalize(F.col("text"))), " ")
    # texts are normalised once for what is equal, and once more where they are no copies
    base = keep(articles.select("id", url_hash(F.col("url")).alias("url"), token_set(normalize_title(F.col("title"))).alias("tokens"), F.sha2(F.nullif(words_of, F.lit("")), 256).alias("words")))
    parts = []

    def folded(reason: str, key: Column) -> DataFrame:
        members, sizes = fold_equal(base, F.nullif(key, F.lit("")))
        parts.append(members.filter("id <> rep").select(F.lit(reason).alias("reason"), F.lit("copy").alias("relation"), F.col("id").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("similarity")))
        return sizes.withColumnRenamed("rep", "id")

    def linked(reason: str, pairs: DataFrame) -> None:
        parts.append(pairs.filter(F.col("similarity") >= least).select(F.lit(reason).alias("reason"), F.lit("near").alias("relation"), "a", "b", "similarity"))

    folded("same URL", F.col("url"))
    heads = base.join(folded("headline", F.array_join(F.array_sort("tokens"), " ")), "id").select("id", "tokens").filter(F.size("tokens") > 0)
    heads = keep(heads)
    few, every = rare_tokens(heads, least), heads.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("key"))
    side = lambda df, k: df.select("key", F.col("id").alias(k), F.col("n").alias(f"n{k}"))
    met = side(few, "x").join(side(every, "y"), "key").filter("nx <= ny and x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    half = lambda k: heads.select(F.col("id").alias(k), F.col("tokens").alias(f"t{k}"))
    linked("headline", met.join(half("a"), "a").join(half("b"), "b").select("a", "b", overlap(F.col("ta"), F.col("tb")).alias("similarity")))
    texts = articles.join(folded("text", F.col("words")), "id").select("id", "text", "copies")
    vectors = keep(likeness.unit_vectors(grams_of(texts.repartition("id")), keep, counts=True))
    linked("text", likeness.alike(vectors, keep, least))
    return reduce(lambda a, b: a.unionByName(b), parts)


#: Copies of a headline that meet others at once, and rows that a bucket of units holds on average.
UNIT, BUCKET = 1024, 512


def duplicate_pairs(articles: DataFrame, keep, least: float = 0.8) -> DataFrame:
    """DUP-3: (a, b, reason, headline, content), a < b, of all articles (id, url, title, text) with the same canonical URL, or
    headlines or texts that are nearly identical, with both measures of each.

    Equal headlines and texts are classes, so what makes a pair is found among classes: then their members meet, in
    units of so many.  A pair whose headlines are alike is told by its classes' units; one of one address by these; one
    of texts by their classes: none is told twice, and no pair is shuffled before it has passed.  Rows of one id are one
    article, the first by its words and address."""
    words = F.array_join(tokens(normalize(F.col("text"))), " ")
    base = articles.select("id", url_hash(F.col("url")).alias("url"), F.array_sort(F.transform(token_set(normalize_title(F.col("title"))), lambda w: F.xxhash64(w))).alias("heads"), words.alias("words"))
    base = keep(first_by(base, ["id"], [F.col("words"), F.col("url"), F.array_join("heads", " ")]))
    in_text, texts = fold_equal(base, F.nullif("words", F.lit("")))
    docs, n = likeness.with_frequencies(base.select("id", "words").join(texts.select(F.col("rep").alias("id"), "copies"), "id"), keep)
    in_head, heads = fold_equal(base, F.nullif(F.array_join("heads", " "), F.lit("")))
    rows = base.select("id", "url", "heads").join(in_text.withColumnRenamed("rep", "text"), "id").join(in_head.withColumnRenamed("rep", "head"), "id")
    rows = keep(rows.join(heads.select(F.col("rep").alias("head"), F.ceil(F.col("copies") / UNIT).alias("units")), "head"))
    told = lambda k: docs.select(F.col("id").alias(k), "words", "dfs")

    # classes of headlines that are alike, each with itself too
    titles = keep(rows.filter("id = head and size(heads) > 0").select("id", F.col("heads").alias("tokens"), "units"))
    few, every = rare_tokens(titles, least), titles.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("key"))
    side = lambda df, k: df.select("key", F.col("id").alias(k), F.col("n").alias(f"n{k}"))
    met = side(few, "x").join(side(every, "y"), "key").filter("nx <= ny and x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    half = lambda k: titles.select(F.col("id").alias(k), F.col("tokens").alias(f"t{k}"), F.col("units").alias(f"u{k}"))
    near = met.join(half("a"), "a").join(half("b"), "b").select("a", "b", "ua", "ub", overlap(F.col("ta"), F.col("tb")).alias("headline")).filter(F.col("headline") >= least)
    own = titles.select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("units").alias("ua"), F.col("units").alias("ub"), F.lit(1.0).alias("headline"))

    # units of classes meet by buckets: each is sent once to every pair of buckets that needs it
    buckets = F.lit(rows.count() // BUCKET + 1)
    unit = lambda head, k: F.xxhash64(head, k)
    some = lambda c, name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)).alias(name)
    pairs = near.unionByName(own).select("*", some("ua", "i")).select("*", some("ub", "j")).filter("a <> b or i <= j").select(unit("a", "i").alias("u"), unit("b", "j").alias("v"), "headline")
    bucket = lambda c: F.pmod(c, buckets)
    pairs = keep(pairs.withColumns({"x": F.least(bucket("u"), bucket("v")), "y": F.greatest(bucket("u"), bucket("v"))}))
    wanted = pairs.select(F.col("x").alias("x"), F.col("y").alias("y"), F.explode(F.array("u", "v")).alias("unit")).distinct()
    members = rows.withColumn("unit", unit("head", F.pmod(F.xxhash64("id"), "units"))).select("unit", "id", "url", "text")
    sent = members.join(told("text"), "text", "left").join(wanted, "unit")
    by_head = sent.groupBy("x", "y").cogroup(pairs.groupBy("x", "y")).applyInArrow(likeness.of_units(n), likeness.MEASURED)

    # the rest of what has one address, and of texts that are alike
    apart = lambda x, y: ~((F.size(x) > 0) & (F.size(y) > 0)) | (overlap(F.col(x), F.col(y)) < least)
    half = lambda k, *by: rows.select(*(F.col(c).alias(f"{c}{k}" if c not in by else c) for c in ("id", "url", "heads", "text")))
    measured = lambda same, content: [F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b"), same.alias("same"), overlap(F.col("headsx"), F.col("headsy")).alias("headline"), content.alias("content")]
    same = half("x", "url").filter("url is not null").join(half("y", "url"), "url").filter("idx < idy").filter(apart("headsx", "headsy"))
    alike = likeness.maybe_alike(likeness.vectors_of(docs, n), keep, least).select(F.col("a").alias("textx"), F.col("b").alias("texty"))
    asked = same.filter("textx <> texty").select(F.least("textx", "texty").alias("textx"), F.greatest("textx", "texty").alias("texty"))
    asked = alike.unionByName(asked).distinct()
    dots = keep(likeness.cosines(asked, docs, n))
    twin = F.when(F.col("textx") == F.col("texty"), F.col("whole")).otherwise(F.coalesce("similarity", F.lit(0.0)))
    flat = lambda df: df.withColumns({"p": F.least("textx", "texty"), "q": F.greatest("textx", "texty")})
    known = dots.select(F.col("textx").alias("p"), F.col("texty").alias("q"), "similarity")
    has = docs.select(F.col("id").alias("textx"), F.lit(1.0).alias("whole"))
    by_url = flat(same).join(known, ["p", "q"], "left").join(has, "textx", "left").withColumn("whole", F.coalesce("whole", F.lit(0.0))).select(*measured(F.lit(True), twin))
    classes = known.filter(F.col("similarity") >= least).select(F.col("p").alias("textx"), F.col("q").alias("texty"), "similarity").unionByName(has.select("textx", F.col("textx").alias("texty"), F.col("whole").alias("similarity")))
    expanded = classes.join(half("x"), "textx").join(half("y"), "texty").filter("textx <> texty or idx < idy")
    by_text = expanded.filter(apart("headsx", "headsy") & ~F.coalesce(F.col("urlx") == F.col("urly"), F.lit(False))).select(*measured(F.lit(False), F.col("similarity")))
    reason = F.when(F.col("same"), F.lit("same URL")).otherwise("near-identical text").alias("reason")
    return by_head.unionByName(by_url).unionByName(by_text).select("a", "b", reason, "headline", "content")


def link_posts(posts: DataFrame, stories: DataFrame, config: EngineConfig = CONFIG, post_hours: int = 48, story_hours: int = CONFIG.match_hours) -> DataFrame:
    """JOIN-7: (post, story, score) - each post's best story of its time.

    posts: post, at, text, entities, events; stories: story, last_seen, headline, entities, events.  A run sees the posts
    of the last 48 hours and the stories of the last 72, so a story counts if its last item is no more than 72 hours
    older than the post and no more than 48 hours newer.  Both sides meet by key and stretch of time: a name that
    all share costs what happens at a time.

    Where either side has names, only names in common lift the score far enough, so these meet by names;
    without any, texts must share a part of their tokens, so their rare tokens meet.  Each row goes to its keys and
    stretches with all that it is compared by, and a task tells the best story of a post: no pair is shuffled.

    Both sides grow with the input.  Catalyst takes a table of keys and times for small by its size on disk, though
    each row becomes several with sets of words, and would gather it in the driver; so joins here are merges."""
    names = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), normalize), lambda n: n != ""))
    said = F.concat_ws(" ", F.col("headline"), F.coalesce("entities", F.array().cast("array<string>")))
    # tables without times are all of one time
    time = lambda df, c: F.unix_micros(F.col(c) if c in df.columns else F.timestamp_seconds(F.lit(0))).alias("t")
    p = posts.select(F.col("post").alias("id"), time(posts, "at"), names("entities").alias("e"), names("events").alias("v"), token_set(normalize(F.col("text"))).alias("w"))
    s = stories.select(F.col("story").alias("id"), time(stories, "last_seen"), names("entities").alias("e"), names("events").alias("v"), token_set(normalize(said)).alias("w"))
    hour = 3_600_000_000
    earlier, later = story_hours * hour, post_hours * hour
    # a stretch holds its stories, and the posts that may be linked to one of them
    stretch = lambda t: F.floor(t / (8 * (earlier + later)))
    bands = {0: F.sequence(stretch(F.col("t") - earlier), stretch(F.col("t") + later)), 1: F.array(stretch(F.col("t")))}
    hashed = [F.transform(c, lambda x: F.xxhash64(x)).alias(c) for c in "evw"]
    key = F.concat(F.transform("e", lambda x: F.xxhash64(F.lit("e"), x)), F.transform("v", lambda x: F.xxhash64(F.lit("v"), x)))
    place = lambda k: (F.lit(k).alias("side"), F.explode(bands[k]).alias("band"))
    columns = ["side", "band", "key", "id", "t", "e", "v", "w"]

    def met(rows: DataFrame, k: int) -> DataFrame:
        return rows.filter("id is not null and t is not null").select("*", *place(k)).select(columns)

    by_name = lambda rows, k: met(rows.select("id", "t", *hashed, F.explode(key).alias("key")), k)
    bare = [rows.filter("size(e) + size(v) = 0 and size(w) > 0") for rows in (p, s)]
    keys = rare_tokens(reduce(DataFrame.unionByName, (rows.select(F.struct(F.lit(k).alias("side"), F.col("id").alias("i")).alias("id"), F.col("w").alias("tokens")) for k, rows in enumerate(bare))), config.post_score / 0.85)
    few = lambda k: keys.filter(F.col("id.side") == k).select(F.xxhash64(F.lit("w"), "key").alias("key"), F.col("id.i").alias("id"))
    by_token = lambda k: met(few(k).join(bare[k].select("id", "t", *hashed).distinct().hint("merge"), "id"), k)
    rows = reduce(DataFrame.unionByName, (by_name(p, 0), by_name(s, 1), by_token(0), by_token(1)))
    rows = rows.withColumn("bucket", F.pmod("key", F.lit(BUCKETS)))
    found = rows.groupBy("band", "bucket").applyInArrow(best_stories(earlier, later, config.post_score), BEST)
    return found.groupBy("post").agg(F.max(F.struct("score", (-F.col("story")).alias("s"))).alias("m")).select("post", (-F.col("m.s")).alias("story"), F.col("m.score").alias("score"))


def same_headlines(stories: DataFrame, prefix: int = 90) -> DataFrame:
    """CLU-4"""
    key = F.substring(normalize(F.col("headline")), 1, prefix)
    return stories.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("stories"), F.min("story").alias("first_story")).filter((F.col("stories") > 1) & (F.col("key") != ""))
