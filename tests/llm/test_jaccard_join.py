"""The join against brute force, on groups that need every one of its rounds."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from evidentia.llm import jaccard_join
from evidentia.llm.components import components


def brute(rows):
    sets = {}
    for key, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[key] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    inverted, shared, parent = defaultdict(list), defaultdict(int), {k: k for k in sets}
    for key, grams in sets.items():
        for gram in grams:
            inverted[gram].append(key)
    for keys in inverted.values():
        for i, a in enumerate(keys):
            for b in keys[:i]:
                shared[a, b] += 1

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {k: (len(s), root(k)) for k, s in sets.items()}


def varied(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    passage = " ".join(word() for _ in range(30))
    texts = [None, "", "  \n", "one", "One", "one two", "ONE two\tthree", "a b c d e", "a b c d e f"]
    for _ in range(4):  # variants of an original, and chains of versions
        original = [word() for _ in range(80)]
        for _ in range(30):
            copy = list(original)
            for _ in range(r.randint(0, 5)):
                copy[r.randrange(80)] = word()
            texts.append(" ".join(copy))
        for _ in range(15):
            original = list(original)
            original[r.randrange(80)] = word()
            original[r.randrange(80)] = word()
            texts.append(" ".join(original).upper())
    texts += [" ".join([word() for _ in range(r.randint(1, 40))] + [passage] + [word() for _ in range(r.randint(0, 20))]) for _ in range(60)]
    texts += [" ".join(word() for _ in range(r.randint(1, 60))) for _ in range(40)] + [texts[20]] * 12
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "short", "parts", "block"), [(1, 8, 100_000, 256), (2, 2, 100_000, 4), (3, 2, 5, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, short, parts, block):
    """The tunables are read on the driver and sent to the workers: small ones need every round."""
    for name, value in (("SHORT", short), ("LIST_POSTINGS", parts), ("BLOCK", block), ("LEADER_PART", 5)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = varied(seed)
    rows.append((len(rows), " ".join(f"w{k * k % 9973}" for k in range(60_000))))  # a very long text and its near copy
    rows.append((len(rows), rows[-1][1] + " and more"))
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.near_duplicates(empty).collect() == []
    rows = [(None, "a b c d e f g"), (7, "a b c d e f g"), (7, "other words stand here now"), (3, None)]
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as sid", "2 as key")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in found) == [("3", 0, 3), ("7", 1, 7), ("7", 3, None), ("None", 3, None)]


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    found = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200, 202: 200}


def test_one_row_of_each_component_stays(spark):
    """Rows that share an id are still told apart: unique texts stay, and of near copies one."""
    r = random.Random(5)
    prose = lambda: [f"w{r.randrange(10_000)}" for _ in range(60)]
    a, b, c, d, e, f = (prose() for _ in range(6))
    near = lambda words, k: " ".join([*words, *(f"more{k}" for _ in range(k))])
    rows = [(1, near(a, 0)), (5, near(a, 1)), (5, near(c, 0)), (7, near(d, 0)), (7, near(d, 1)), (9, near(d, 2)), (None, near(e, 0)), (None, near(e, 1)), (None, near(f, 0)), (3, near(e, 2)), (4, near(b, 0)), (4, near(b, 0)), (8, ""), (8, None)]
    kept = [tuple(x) for x in jaccard_join.keep_smallest(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    groups = {w[0]: name for name, w in zip("abcdef", (a, b, c, d, e, f), strict=True)}
    assert all(x in rows for x in kept)
    assert sorted((groups.get((t or "").split(" ")[0], ""), str(i)) for i, t in kept) == [("", "8"), ("", "8"), ("a", "1"), ("b", "4"), ("c", "5"), ("d", "7"), ("e", "None"), ("f", "None")]


def test_bitmaps_never_hide_a_link():
    """The bound on the overlap of two sets holds, and tells most sets apart that share little."""
    r, told = np.random.default_rng(3), 0
    for _ in range(400):
        n, shared = int(r.integers(1, 400)), r.random()
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        kept = int(shared * len(a))
        b = np.unique(np.concatenate([a[:kept], r.integers(0, 1 << 63, max(1, int((len(a) - kept) * r.uniform(0.8, 1.2))), dtype=np.uint64)]))
        if not 0.75 <= len(a) / len(b) <= 4 / 3:
            continue
        x, y = sorted((jaccard_join._bitmap(a), jaccard_join._bitmap(b)), key=len)
        y = y if len(x) == len(y) else y[: len(x)] ^ y[len(x) :]
        bound = (len(a) + len(b) - int(np.bitwise_count((x ^ y).view(np.uint64)).sum())) // 2
        assert bound >= len(np.intersect1d(a, b))
        told += 100 * bound < 75 * (len(a) + len(b) - bound)
    assert told > 100


def test_sketch_reaches_the_driver_packed_and_settled_lists_are_left_alone(spark, monkeypatch):
    """What the driver holds follows from what the sketch counted, and goes before the rounds; components are found anew
    only where links were, and lists of one component aren't looked at again."""
    found = []
    real = jaccard_join.components
    monkeypatch.setattr(jaccard_join, "components", lambda links: found.append(links.count()) or real(links))
    copies = [(k, " ".join(f"w{i}" for i in range(60)) + f" x{k}") for k in range(20)]
    # four of five windows in common with the others of their kind: one list, and nothing is alike by three quarters
    apart = [(100 + k, f"a b c d e f g h y{k}") for k in range(12)]
    join = jaccard_join._Join(spark.createDataFrame(copies + apart, "doc_id long, text string").repartition(3), "doc_id", "text", 5, 75)
    join.profile()
    assert sum(map(len, join.levels.value.values())) < (1 << jaccard_join.SKETCH_BITS) // 100
    join.candidates()
    with pytest.raises(Exception, match="destroyed"):
        join.spark.sparkContext.parallelize([0]).map(lambda _, sent=join.levels: sent.value).collect()
    members, shared = join.lists.count(), set()
    leads = jaccard_join._Join._leads
    monkeypatch.setattr(jaccard_join._Join, "_leads", lambda self, placed: shared.add(placed.count()) or leads(self, placed))
    links = join.links()
    assert links.count() >= 19 and join.labels.select("root").distinct().count() == 1
    assert len(found) == 1 and shared == {12} and members > 200
