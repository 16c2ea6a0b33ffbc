"""The pipeline stage by stage against brute force, on the smallest tables with odd rows added."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from evidentia.llm import pii, quality  # noqa: E402
from evidentia.llm.common import materialise  # noqa: E402
from test_jaccard_join import brute  # noqa: E402


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prose = next(r.text for r in docs.collect() if 300 < len(r.text.split()) < 900 and len(set(r.text.split())) > 150)
    more = [(9_001, None, "en", "s", 0), (9_002, "", "en", "s", 0), (9_003, prose, "en", "s", len(prose)), (9_004, prose, None, "s", 1), (9_005, prose + " and more", "en", "s", 1), (None, prose.upper(), "en", "s", 1)]
    docs = materialise(docs.unionByName(spark.createDataFrame(more, docs.schema)), "input")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    at = columns.index("text")

    kept = {(r.doc_id, r.n_words) for r in quality.judge(docs, ["doc_id"]).collect() if r.kept}
    good = materialise(stages["quality_rules"](spark, docs, sf_dir), "a")
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert good.columns == columns
    assert Counter(rows(good)) == Counter(r for r in rows(docs) if (r[0], words(r[at])) in kept)

    unique = materialise(stages["exact_dedup"](spark, good, sf_dir), "b")
    groups = defaultdict(list)
    for r in rows(good):
        groups[r[at] or ""].append(r)
    assert unique.columns == columns
    assert Counter(rows(unique)) == Counter(max(g, key=lambda r: -(1 << 63) if r[0] is None else r[0]) for g in groups.values())

    single = materialise(stages["near_dedup"](spark, unique, sf_dir), "c")
    low = lambda k: -1 if k is None else k
    roots = brute([(low(r[0]), r[at]) for r in rows(unique)])
    assert single.columns == columns
    assert Counter(rows(single)) == Counter(r for r in rows(unique) if roots[low(r[0])][1] == low(r[0]))

    clean = materialise(stages["pii"](spark, single, sf_dir), "d")
    spans = {r.doc_id: r.spans for r in pii.report(single).collect()}

    def redacted(r):
        out, at_ = "", 0
        for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans[r[0]].split(",") if s)), key=lambda s: (s[1], s[2], s[0])):
            out += (r[at] or "")[at_ : max(a, at_)] + f"[{kind.upper()}]"
            at_ = max(at_, b)
        return out + (r[at] or "")[at_:]

    want = {r[0]: redacted(r) for r in rows(single)}
    assert clean.columns == columns
    assert {r.doc_id: r.text for r in clean.collect()} == want
    assert all(r.n_chars == len(r.text) for r in clean.collect())

    packed = stages["packing"](spark, clean, sf_dir).collect()
    tokenizer, pieces = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for key, text in want.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or min(len(ids), 2048)
        for piece, start in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[start : first if piece == 0 else start + 2048]
            pieces[key, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == pieces


def test_run_equals_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    keys = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert Counter(rows(corpus_pipeline.run(spark, sf_dir).select(*keys))) == Counter(rows(docs.select(*keys)))


NAMES = ["found", "key", "sid", "lm_lang", "row number", "content", "length", "best_id"]


def test_stages_on_odd_tables(spark, sf_dir):
    """An empty table, and very long texts, nulls, repeats and columns that the stages use themselves."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], kinds)
    prose = " ".join(f"word{k * k % 997} and" for k in range(60))
    long = " ".join(f"w{k * k % 99_991}" for k in range(80_000))
    odd = spark.createDataFrame([(1, prose, "en", "s", 1), (1, prose, "en", "s", 1), (None, prose + " a@b.co", None, None, None), (3, long, "en", "s", 2), (4, None, None, None, None), (5, "", "en", "s", 0)], kinds)
    for name in NAMES:
        odd = odd.withColumn(name, F.lit(name))
    for docs, rows in ((empty, 0), (odd, 6)):
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = materialise(stage(spark, docs, sf_dir), name)
            assert name == "packing" or docs.columns == columns
            assert rows or docs.isEmpty()
        if rows:
            assert {r.doc_id for r in docs.collect()} <= {1, 3, None}
