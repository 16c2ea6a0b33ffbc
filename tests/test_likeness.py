"""Articles compared as vectors by stretches of time."""

import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evidentia.operators import likeness, matching
from evidentia.sources.scratch import keep

START = dt.datetime(2024, 5, 1, 12)


def brute(rows, hours, least):
    """Cosines and overlaps of all pairs near in time, in plain Python; words here need no normalising."""
    grams = {k: (w := text.split()) + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)] for k, _, _, text in rows}
    df = Counter(g for v in grams.values() for g in set(v))
    n = sum(1 for v in grams.values() if v)
    raw = {k: {g: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[g])) + 1) for g, c in Counter(v).items()} for k, v in grams.items()}
    unit = {k: {g: x / math.sqrt(sum(y * y for y in v.values())) for g, x in v.items()} for k, v in raw.items()}
    out = {}
    for a, ta, ha, _ in rows:
        for b, tb, hb, _ in rows:
            if a < b and abs((ta - tb).total_seconds()) <= hours * 3600:
                x, y = set(ha.split()), set(hb.split())
                content, headline = sum(v * unit[b].get(g, 0.0) for g, v in unit[a].items()), len(x & y) / max(min(len(x), len(y)), 1)
                if max(content, headline) >= least:
                    out[a, b] = round(content, 9), round(headline, 9)
    return out


@pytest.mark.parametrize(("block", "common", "columns"), [(1024, 24, 1024), (7, 2, 3)])
def test_near_pairs_are_all_pairs(spark, monkeypatch, block, common, columns):
    """Over several stretches, in blocks and as one, with empty texts and headlines: no pair is lost, none comes twice."""
    monkeypatch.setattr(likeness, "BLOCK", block)
    rng = random.Random(5)
    some = lambda most: " ".join(f"w{min(rng.randint(0, 60), rng.randint(0, 60))}" for _ in range(rng.randint(0, most)))
    rows = [(k, START + dt.timedelta(minutes=rng.randint(0, 60 * 24 * 20)), some(4), some(30)) for k in range(160)]
    articles = spark.createDataFrame(rows, "id long, at timestamp, title string, text string").repartition(3)
    found = matching.near_pairs(articles, keep, hours=30).collect()
    least = matching.CONFIG.reply_text_similarity
    want = brute(rows, 30, least)
    got = {(r.a, r.b): (round(r.content, 9), round(r.headline, 9)) for r in found}
    assert len(got) == len(found) and got == want
    # both ways to multiply, over grams of many and of few
    lists = articles.select(F.transform(F.split("text", " "), lambda w: F.xxhash64(w)).alias("k")).select(F.array_distinct("k").alias("k")).toArrow()["k"].combine_chunks()
    sets = [set(x) for x in lists.to_pylist()]
    monkeypatch.setattr(likeness, "COMMON", common)
    monkeypatch.setattr(likeness, "COLUMNS", columns)
    dots = likeness.products(lists, None)
    assert all(dots[i, j] == len(sets[i] & sets[j]) for j in range(len(sets)) for i in range(j))


def test_a_pair_costs_no_row_for_each_word_in_common(spark):
    """Long texts of few words share thousands of grams a pair; they meet as two rows."""
    words = [f"w{k}" for k in range(300)]
    rng = random.Random(6)
    rows = [(k, START + dt.timedelta(hours=k), "", " ".join(rng.choices(words, k=3000))) for k in range(300)]
    articles = keep(spark.createDataFrame(rows, "id long, at timestamp, title string, text string"))
    vectors = keep(articles.select("id", F.array().cast("array<bigint>").alias("heads")).join(likeness.unit_vectors(matching.grams_of(articles), keep), "id"))
    plan = likeness.near_pairs(vectors, articles.select("id", "at"), 72, 0.02)
    assert plan.count() == sum(min(72, k) for k in range(300))


@pytest.mark.parametrize("least", [0.3, 0.8])
def test_alike_are_all_pairs_whatever_their_times(spark, least):
    """Near copies, chance words in common, empty texts: the pairs and cosines of brute force, from few that move their vectors."""
    rng = random.Random(7)
    bases = [[f"w{min(rng.randint(0, 400), rng.randint(0, 400))}" for _ in range(rng.randint(1, 60))] for _ in range(25)]
    rows = [(0, START, "", "")]
    for k in range(1, 200):
        words = [f"w{rng.randint(0, 400)}" if rng.random() < 0.08 else w for w in rng.choice(bases)]
        rows.append((k, START, "", " ".join(words)))
    articles = spark.createDataFrame(rows, "id long, at timestamp, title string, text string").repartition(3)
    moved = []
    vectors = keep(likeness.unit_vectors(matching.grams_of(articles), keep, counts=True))
    found = likeness.alike(vectors, lambda df: moved.append(keep(df)) or moved[-1], least).collect()
    got = {(r.a, r.b): round(r.similarity, 9) for r in found if r.similarity >= least}
    want = {k: content for k, (content, _) in brute(rows, 1, least).items()}
    assert len(got) > 100 and got == want
    assert moved[-1].columns == ["a", "b"] and moved[-1].count() < 199 * 198 / 4
