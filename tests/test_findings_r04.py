"""What the findings of round 4 named, on rows made by hand."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from evidentia import plans
from evidentia.functions import text
from evidentia.operators import classify, likeness, matching, posts
from evidentia.plans import newsroom
from evidentia.sources.scratch import keep

from test_likeness import START, brute

ARTICLE = "id long, at timestamp, title string, text string"


def written(rows, n=160, hours=480):
    some = lambda most: " ".join(f"w{min(rows.randint(0, 60), rows.randint(0, 60))}" for _ in range(rows.randint(0, most)))
    return [(k, START + dt.timedelta(minutes=rows.randint(0, 60 * hours)), some(4), some(30)) for k in range(n)]


@pytest.mark.parametrize("chars", [8_000_000, 100])
def test_texts_meet_as_words(spark, monkeypatch, chars):
    """no gram and no vector is written, whatever the parts in which grams are counted; a repeated row counts in its
    document, one without a time counts and meets nothing."""
    monkeypatch.setattr(likeness, "COUNT_CHARS", chars)
    monkeypatch.setattr(likeness, "BLOCK", 30)
    rows, kept = written(random.Random(9)), []
    articles = spark.createDataFrame(rows, ARTICLE).repartition(3)
    found = matching.near_pairs(articles, lambda df: kept.append(keep(df)) or kept[-1], hours=30).collect()
    least = matching.CONFIG.reply_text_similarity
    got = {(r.a, r.b): (round(r.content, 9), round(r.headline, 9)) for r in found}
    assert got == brute(rows, 30, least) and len(got) == len(found)
    assert all(kind not in ("array<bigint>", "array<double>") for df in kept for _, kind in df.dtypes)
    assert sum(df.count() for df in kept) < len(rows)
    # the same counts, but the last row has no time
    late = [*rows[:-1], (*rows[-1][:1], None, *rows[-1][2:])]
    found = matching.near_pairs(spark.createDataFrame(late, ARTICLE), keep, hours=30).collect()
    assert {(r.a, r.b): (round(r.content, 9), round(r.headline, 9)) for r in found} == {k: v for k, v in got.items() if rows[-1][0] not in k}
    assert len(found) < len(got)


def test_normalised_texts_are_as_before(spark):
    """One pattern for a run gives what one for each sign and one for white space gave."""
    odd = ["", " ", None, "A&B", "a -- b\t\n--c", "É́té \U0001f600\U0001f600x", " x y z", "--", "a_b\x0b\x1cc", "ß ſ İ K", "1,000.5"]
    words = F.replace(F.lower(text.strip_accents(F.coalesce("t", F.lit("")))), F.lit("&"), F.lit(" and "))
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select(text.normalize(F.col("t")).alias("now"), text.collapse(F.regexp_replace(words, r"[^a-z0-9\s]", " ")).alias("then")).collect()
    assert [r.now for r in rows] == [r.then for r in rows] and rows[4].now == "a b c"


def linked(post, story):
    """JOIN-7's score of (id, at, text, entities, events), in plain Python."""
    (_, tp, xp, ep, vp), (_, ts, xs, es, vs) = post, story
    if not -48 <= (tp - ts).total_seconds() / 3600 <= 72:
        return 0.0
    a, b = set(xp.split()), set(xs.split()) | set(es)
    part = lambda x, y: len({*x} & {*y}) / max(min(len({*x}), len({*y})), 1)
    people, event, shared = part(ep, es), part(vp, vs), len(a & b)
    if ep and es and not people or not people and not event and shared < 3:
        return 0.0
    text = shared / max(len(a | b), 1)
    return round(0.45 * people + 0.25 * event + 0.30 * text if ep or es or vp or vs else 0.85 * text, 9)


@pytest.mark.parametrize("block", [2048, 5])
def test_posts_and_stories_meet_without_pairs(spark, monkeypatch, block):
    """the best stories are those of brute force, and nothing is shuffled by post and story."""
    monkeypatch.setattr(posts, "POSTS", block)
    monkeypatch.setattr(posts, "STORIES", block)
    rng = random.Random(12)
    names = lambda most, of: rng.sample(of, rng.choice([0, 0, most]) and rng.randint(0, most))
    made = lambda n: [(k, START + dt.timedelta(hours=rng.randint(0, 400)), " ".join(rng.choices([f"w{i}" for i in range(9)], k=rng.randint(0, 9))), names(2, ["na", "nb", "nc"]), names(1, ["ua", "ub"])) for k in range(n)]
    ps, ss = made(150), made(120)
    kinds = "{} long, {} timestamp, {} string, entities array<string>, events array<string>"
    found = matching.link_posts(spark.createDataFrame(ps, kinds.format("post", "at", "text")), spark.createDataFrame(ss, kinds.format("story", "last_seen", "headline")))
    assert not re.search(r"hashpartitioning\(post#\d+L?, story", found._jdf.queryExecution().executedPlan().toString())
    want = {}
    for p in ps:
        score, story = max((linked(p, s), -s[0]) for s in ss)
        if score >= matching.CONFIG.post_score:
            want[p[0]] = (-story, score)
    assert {r.post: (r.story, round(r.score, 9)) for r in found.collect()} == want and len(want) > 60


def test_every_pair_of_duplicates_is_told(spark, monkeypatch):
    """F1, F8: pairs of copies too, once each, with both measures, whatever the units in which classes meet."""
    monkeypatch.setattr(matching, "UNIT", 4)
    monkeypatch.setattr(matching, "BUCKET", 16)
    rng = random.Random(13)
    some = lambda most: " ".join(rng.choices([f"w{i}" for i in range(40)], k=rng.randint(0, most)))
    heads, texts = [some(5) for _ in range(25)], [some(25) for _ in range(20)]
    changed = lambda t: " ".join(w for w in t.split() if rng.random() > 0.05)
    rows = [(k, START, rng.choice(heads), changed(rng.choice(texts)), f"http://a.org/{rng.randint(0, 40)}" if rng.random() > 0.2 else None) for k in range(120)]
    kept = []
    articles = spark.createDataFrame(rows, f"{ARTICLE}, url string").repartition(3)
    found = matching.duplicate_pairs(articles.unionByName(articles.limit(5)), lambda df: kept.append(keep(df)) or kept[-1]).collect()
    near = brute([r[:4] for r in rows], 1, 1e-9)
    want = {}
    for b in rows:
        for a in rows[: b[0]]:
            content, headline = near.get((a[0], b[0]), (0.0, 0.0))
            same = a[4] is not None and a[4] == b[4]
            if same or max(content, headline) >= 0.8:
                want[a[0], b[0]] = ("same URL" if same else "near-identical text", headline, content)
    got = {(r.a, r.b): (r.reason, round(r.headline, 9), round(r.content, 9)) for r in found}
    assert len(got) == len(found) and got == want
    assert sum(r[0] == "near-identical text" for r in want.values()) > 100 and any(max(r[1:]) < 0.8 for r in want.values())
    # no vector is written
    assert not any(kind == "array<double>" for df in kept for _, kind in df.dtypes)


def test_card_changes_work_out_categories_alone(spark, sf_dir):
    """what is read of an article for its changes is its category, as `enrich` has it; credits and flags are left to who asks."""
    rows = newsroom.articles(spark, sf_dir)
    of = lambda df: {r.id: (r.category, r.intent) for r in df.select("id", "category", "intent").collect()}
    assert of(classify.categorise(rows)) == of(classify.enrich(rows))
    plan = plans.QUERIES["res_card_changes"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "attribution_outlets" not in plan and "denial_terms" not in plan


def test_titles_are_cleaned_as_before(spark):
    """texts without markup, entities or marks skip these replacements, and come out the same."""
    names = "|".join(name.replace(" ", r"\s?") for name in text.PUBLISHERS)
    name = text.PUBLISHERS[0]
    odd = ["", " ", None, f"A - {name}", f"A | {name} - {name}.com ", f"A &ndash; {name}", f"A {name}", "a <b>c</b> &amp;amp; d", "x < y & z", "a  b\tc", f"<i>A</i>&mdash;{name}", "-"]
    t = F.col("t")
    bare = F.regexp_replace(t, "<[^>]+>", " ")
    for e, to in text.ENTITIES.items():
        bare = F.replace(bare, F.lit(e), F.lit(to))
    then = F.trim(F.regexp_replace(text.collapse(bare), rf"(?i)(?:\s*[|–—-]\s*(?:{names})(?:\.com)?\s*)+$", ""))
    rows = spark.createDataFrame([(x,) for x in odd], "t string").select(text.clean_title(t).alias("now"), then.alias("then")).collect()
    assert [r.now for r in rows] == [r.then for r in rows] and rows[3].now == rows[5].now == "A"
