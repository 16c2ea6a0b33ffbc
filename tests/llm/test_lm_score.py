"""Scores against a plain dictionary model."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evidentia.llm.lm_score import score


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, order=3):
    docs = [words_of(t) for _, t in rows]
    grams = lambda d: Counter(tuple(d[i - n + 1 : i + 1]) for n in range(1, order + 1) for i in range(n - 1, len(d)))
    whole, total = sum(map(grams, docs), Counter()), sum(map(len, docs))
    out = Counter()
    for (key, _), d in zip(rows, docs, strict=True):
        own, value, backed = grams(d), 0.0, 0
        seen = lambda g: whole[g] - own[g]  # noqa: E731, B023
        for i in range(len(d)):
            most = min(order, i + 1)
            for n in range(most, 0, -1):
                g = tuple(d[i - n + 1 : i + 1])
                if n == 1:
                    value += math.log(max(seen(g), 1) / max(total - len(d), 1))
                    backed += most > 1 or not seen(g)
                elif seen(g):
                    value += math.log(seen(g) / seen(g[:-1]))
                    backed += n < most
                else:
                    value += math.log(0.4)
                    continue
                break
        out[key, len(d), backed, round(value, 3)] += 1
    return out


def near(found, want):
    """Equal but for the last digit of the sums."""
    found, want = (sorted(c.elements(), key=lambda r: (r[0] is None, *map(str, r[:3]), r[3])) for c in (found, want))
    return len(found) == len(want) and all(f[:3] == w[:3] and abs(f[3] - w[3]) <= 0.0021 for f, w in zip(found, want, strict=True))


@pytest.mark.parametrize("order, block", [(3, 1_000_000), (3, 500), (1, 2_000), (4, 3_000)])
def test_equals_brute_force(spark, sf_dir, order, block):
    """Odd rows: null, empty, blank, one word, repeated ids and texts, a long text, clashing names."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = [(10_001, None), (10_002, ""), (10_003, "a"), (None, "the THE the"), (None, None), (10_004, " \t\n"), (10_005, "one two three"), (10_005, "One two four"), (10_006, "one two three"), (10_007, "é 中文 one two"), (10_008, "word and " * 30_000)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({"key": F.lit("k"), "block": F.lit(1), "score": F.lit(0.5), "n": F.lit(None)}).repartition(3).cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = score(docs, order=order, block_words=block).collect()
    assert near(Counter((r.doc_id, r.n_tokens, r.n_backed_off, r.log_score) for r in found), brute(rows, order))
    assert all(r.mean_log_score == pytest.approx(r.log_score / max(r.n_tokens, 1), abs=1e-4) for r in found)


def test_a_text_that_occurs_twice_scores_higher(spark):
    rows = [(k, " ".join(f"w{(k * 7 + i * (k + 3)) % 97}" for i in range(60))) for k in range(40)] + [(100, " ".join(f"w{i * i % 97}" for i in range(60)))] * 2
    found = score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert min(r.mean_log_score for r in found if r.doc_id == 100) > max(r.mean_log_score for r in found if r.doc_id < 100)


def test_empty_table(spark):
    assert score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
