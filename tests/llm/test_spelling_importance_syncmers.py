"""Spelling variants, importance resampling and syncmer fingerprints against brute force, on odd rows and on whole tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidentia.llm import importance, spelling, syncmers
from evidentia.llm.queries import op11_pivotal_spelling, op12_importance_resampling, op13_closed_syncmers, oracle_sql

ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "the same nonesuchly"), (6, "the same nonesuchly"), (6, "the same nonesuchly"), (None, "the same nonesuchly"), (None, None), (7, "é😀 ünï  中文 x\u0085y ×÷ ÉCOUTER"),
    (8, "wonderful words " * 5_000), (9, "x" * 50_000), (10, "wonderfull wonderfully wonderul wondrful"), (11, "wonderfull\x00wonderfully wonderul"), (-5, "écoutera écouterai écouterai écoutera " * 12), (1 << 40, "abcdefg abcdefgh bcdefgh " * 2),
]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(40).withColumn("doc_id", F.col("doc_id") + 1000)
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    names = {c: F.lit("k") for c in ("word", "n", "key", "last", "rank", "weight", "part", "follows", "place__")}
    return own.unionByName(odd).withColumns(names).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture
def none(docs):
    return docs.limit(0)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    out = {}
    for w, n in words.items():
        near = [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, []) if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        out[w] = (n, len(near), best if best and words[best] >= 10 * n else None)
    for w, (n, k, form) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        yield w, form, root, n, k, words[form] if form else None


def test_variants(docs, rows):
    found = spelling.variants(docs).collect()
    assert sorted(map(tuple, found), key=str) == sorted(brute_variants(rows), key=str)


def test_variants_of_words_made_alike(spark):
    """Words of few letters: equal grams, ties of rarity, shared beginnings and ends, every kind of edit."""
    rng = random.Random(7)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(4, 9))) for _ in range(700)}
    words |= {"a" * n for n in range(4, 12)} | {"ab" * n + "c" * m for n in range(2, 6) for m in range(3)}
    words = sorted(words)
    table = spark.createDataFrame([(w, 1 + hash(len(w)) % 5) for w in words], "word string, n long").repartition(3)
    found = Counter(frozenset((r.a, r.b)) for r in spelling.near_pairs(table).collect())
    assert found == Counter(frozenset(p) for p in itertools.combinations(words, 2) if one_edit(*p))


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = random.Random(3)
    for _ in range(500):
        costs = [rng.randint(1, 6) for _ in range(rng.randint(3, 9))]
        prefix, pivots, last = spelling.prefix_and_pivots(costs, costs)
        assert prefix == [i for i, c in enumerate(costs) if c <= last] and len(prefix) >= 3
        assert pivots[1] - pivots[0] >= 2 and set(pivots) <= set(prefix)
        assert costs[pivots[0]] + costs[pivots[1]] == min(costs[i] + costs[j] for i in prefix for j in prefix if j - i >= 2)


def test_roots_follow_forms_to_the_end(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(9)] + [("x", "y")]
    assert dict(map(tuple, spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect())) == {f"w{k}": "w9" for k in range(9)} | {"x": "y"}


def test_variants_are_found_in_any_order_of_tasks(docs, monkeypatch):
    whole = sorted(map(tuple, spelling.variants(docs).collect()), key=str)
    monkeypatch.setattr(spelling, "HELD", 5)
    monkeypatch.setattr(spelling, "BATCH", 7)
    assert sorted(map(tuple, spelling.variants(docs.repartition(1)).collect()), key=str) == whole


@pytest.mark.parametrize("query", [op11_pivotal_spelling, op12_importance_resampling])
def test_against_sql(spark, sf_dir, query):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    found = query(spark, sf_dir)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(con.execute(f"SELECT {', '.join(found.columns)} FROM ({oracle_sql()[query.__name__]})").fetchall(), key=str)


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_resample(rows, target, orders, buckets, seed, least, share):
    def features(text):
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return len(words), [zlib.crc32(" ".join(words[k : k + n]).encode()) % buckets for n in range(orders[0], orders[1] + 1) for k in range(len(words) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (t0 := s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    assert t0
    out = []
    for doc_id, text in rows:
        n_words, found = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words >= least))
    drawn = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] if r[0] is not None else -math.inf, -r[2], r[1]))
    ranks = {id(r): k + 1 for k, r in enumerate(drawn[: share * len(drawn) // 100])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=str)


@pytest.mark.parametrize(("orders", "head", "pairs"), [((1, 1), 1 << 16, 0), ((1, 1), 3, 0), ((1, 2), 1 << 16, 50), ((2, 3), 40, 10), ((1, 2), 0, 0)])
def test_resample(spark, docs, rows, sf_dir, orders, head, pairs):
    """Whatever the size of the head, features come into the same buckets."""
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = importance.resample(docs, target, share=30, orders=orders, buckets=97, seed=5, least=4, head_words=head, head_pairs=pairs)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=str) == brute_resample(rows, [r.text for r in target.collect()], orders, 97, 5, 4, 30)


def test_drawn_documents_keep_their_columns(spark, docs, sf_dir):
    kept = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = importance.drawn(kept, target, share=50, least=1)
    assert found.columns == kept.columns
    assert {r.doc_id for r in found.collect()} == {r.doc_id for r in importance.resample(kept, target, share=50, least=1).filter("rank is not null").collect()}


def test_ranks_are_gapless_over_ties(spark):
    table = spark.range(5000).select((F.col("id") % 3).alias("x"), "id").repartition(7)
    found = importance.ranked(table, [F.desc("x"), F.col("id")]).orderBy("rank").collect()
    assert [r["rank"] for r in found] == list(range(1, 5001))
    assert [(r.x, r.id) for r in found] == sorted(((k % 3, k) for k in range(5000)), key=lambda p: (-p[0], p[1]))


def test_empty_tables(spark, none):
    assert spelling.variants(none).count() == 0
    assert importance.resample(none, none).count() == 0
    assert importance.resample(none.unionByName(none), none).count() == 0
    assert syncmers.report(none).count() == syncmers.fingerprints(none).count() == syncmers.positions(none).count() == 0


def brute_anchors(text):
    """By the definition, run by run."""

    def mix(h):
        h = ((h ^ h >> 15) * 0x2C1B3C6D) & 0xFFFFFFFF
        return h ^ h >> 12

    odd = [int(x) for x in syncmers._ODD]
    out = []
    for i in range(len(text) - syncmers.K + 1):
        run = [ord(c) for c in text[i : i + syncmers.K]]
        inner = [mix(sum(c * o for c, o in zip(run[j : j + syncmers.S], odd, strict=True)) & 0xFFFFFFFF) for j in range(syncmers.K - syncmers.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            h = 0
            for j in range(0, syncmers.K, syncmers.S):
                h = (h * odd[1] & 0xFFFFFFFF) ^ inner[j]
            out.append((i, mix(h) & 0xFFFFF))
    return out


TEXTS = st.one_of(st.text(max_size=120), st.text("ab", max_size=200), st.text("abcdefgh é\U0001f600", min_size=20, max_size=300))


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_anchors(text):
    at, hashes = syncmers.anchors(syncmers.code_points(text))
    assert list(zip(at.tolist(), hashes.tolist(), strict=True)) == brute_anchors(text)
    # one at least of so many runs, so distances fit four bits
    assert all(g <= syncmers.K - syncmers.S for g in np.diff(at, prepend=-1))
    own = syncmers.Text(text)
    n, places, found = syncmers.decoded(own.fingerprint())
    assert n == len(text) and found.tolist() == own.hashes.tolist() and (places.tolist() == at.tolist() or not len(at))


@settings(max_examples=150, deadline=None)
@given(TEXTS, TEXTS)
def test_edited_texts_reuse_anchors(a, b):
    text, at, hashes = syncmers.edited(syncmers.Text(a), syncmers.Text(b))
    half = len(a) // 2
    fresh = syncmers.Text(a[: len(a) - half] + b[:half])
    assert text == fresh.text and at.tolist() == fresh.at.tolist() and hashes.tolist() == fresh.hashes.tolist()


def brute_alike(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return 2 * best[-1][-1] / (len(a) + len(b))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=25, unique=True), st.lists(st.integers(0, 30), max_size=25, unique=True))
def test_alike_is_the_longest_common_order(a, b):
    """Of distinct anchors the pairs are given, so the chain is the longest common subsequence."""
    x, y = np.array(a, np.uint32), np.array(b, np.uint32)
    assert syncmers.alike(x, y) == syncmers.alike(y, x) == brute_alike(a, b)


def brute_report(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for k, (doc_id, text) in enumerate(order):
        a, b = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(a) // 2
        new = a[: len(a) - half] + b[:half]
        own, edit, after = syncmers.Text(a), syncmers.Text(new), syncmers.Text(b)
        yield doc_id, len(a), hashlib.sha256(new.encode()).hexdigest(), own.fingerprint(), edit.fingerprint(), syncmers.alike(own.hashes, edit.hashes), syncmers.alike(own.hashes, after.hashes)


@pytest.mark.parametrize("size", [16 << 20, 2_000])
def test_report(docs, rows, monkeypatch, size):
    """Small ranges make many texts the first of their range.  One row of each key, as ties of keys go by a hash."""
    monkeypatch.setattr(syncmers, "RANGE_BYTES", size)
    once = docs.dropDuplicates(["doc_id"]).cache()
    kept = [(r.doc_id, r.text) for r in once.collect()]
    found = syncmers.report(once.withColumn("h", F.lit(0)))
    assert found.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute_report(kept), key=str)
    repeated = syncmers.report(docs)
    assert Counter(r.doc_id for r in repeated.collect()) == Counter(d for d, _ in rows)


def test_report_of_one_and_of_a_whole_table(spark, sf_dir, monkeypatch):
    one = spark.createDataFrame([(7, "a text of its own, followed by itself, some fifty letters long")], "doc_id int, text string")
    (row,) = syncmers.report(one).collect()
    assert row.near_next == 1 and row.doc_id == 7
    monkeypatch.setattr(syncmers, "RANGE_BYTES", 50_000)
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = op13_closed_syncmers(spark, sf_dir).collect()
    assert sorted(map(tuple, found)) == sorted(brute_report([(r.doc_id, r.text) for r in table.collect()]))
    # half of a text of some length is still there, the next text is another
    long = [r for r in found if r.n_chars >= 400]
    assert sum(0.4 <= r.near_edited for r in long) >= 0.95 * len(long) and sum(r.near_next < 0.1 for r in long) >= 0.9 * len(long)


def test_hot_key(spark):
    """Many rows without a key, and many with one text."""
    rows = [(None, f"text number {k % 50} of the rows without a key, long enough for anchors") for k in range(3000)] + [(k, "the very same text under very many keys, long enough") for k in range(3000)]
    found = syncmers.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    same = found.filter("doc_id is not null")
    assert found.count() == 6000 and same.select("fingerprint").distinct().count() == 1
    assert same.filter("near_next = 1").count() == 2999


def test_fingerprints_and_positions(docs, rows):
    got = {(r.doc_id, r.fingerprint) for r in syncmers.fingerprints(docs).collect()}
    assert got == {(d, syncmers.Text(t or "").fingerprint()) for d, t in rows}
    places = Counter((r.doc_id, r.place, r.hash) for r in syncmers.positions(docs).collect())
    assert places == Counter((d, i, h) for d, t in rows for i, h in (zip(*(x.tolist() for x in syncmers.anchors(syncmers.code_points(t or ""))), strict=True)))
    pairs = syncmers.fingerprints(docs).select(F.col("fingerprint").alias("x"), F.col("fingerprint").alias("y"))
    assert {r.likeness for r in syncmers.likeness(pairs, "x", "y").collect()} == {1.0}
