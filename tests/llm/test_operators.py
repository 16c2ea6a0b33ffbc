"""The operators against brute force, on odd rows: nulls, empty and long texts, ties, repeats, clashing names."""

import base64
import gzip
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidentia.llm import bpe, exact_dedup, packing, pii, quality, sharding, url_filter, warc
from evidentia.llm.common import new_path
from evidentia.llm.pretokens import splitter
from evidentia.llm.queries import URL_RULES, oracle_sql

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "the same"), (6, "the same"), (6, "the same"), (None, "the same"), (None, None), (7, "é😀 ünï  中文"), (8, "word " * 20_000), (9, "x" * 50_000),
    (10, "write to ann.b@mail.example.com or +1 (743) 555-3824, card 4111 1111 1111 1111, host 10.0.0.256 and 8.8.8.8"), (11, "\x01a@b.co\x01 <|endoftext|>"), (12, "I'll we'RE don't  go\r\n\r\n12 345"),
]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").limit(60).withColumn("doc_id", F.col("doc_id") + 1000)
    odd = spark.createDataFrame([(*r, "en" if k % 2 else None) for k, r in enumerate(ODD)], "doc_id long, text string, lang string")
    # names that the operators use themselves
    return own.unionByName(odd).withColumns({"key": F.lit("k"), "rep": F.lit(1.5), "length": F.lit(True), "n_words": F.lit(0)}).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def low(x):
    return -(1 << 63) if x is None else x


@pytest.mark.parametrize("budget", [48 << 20, 3_000])
def test_exact_dedup(docs, rows, budget):
    """A small budget makes the map side flush and the Grace side partition again and again."""
    groups = defaultdict(list)
    for key, text in rows:
        groups[text or ""].append(key)
    found = exact_dedup.decisions(docs, budget=budget).collect()
    want = Counter((k, max(g, key=low), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for k in g)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == want
    kept = [r for r in found if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    left = exact_dedup.keep_one(docs, budget=budget)
    assert left.columns == docs.columns
    assert Counter(r.text or "" for r in left.collect()) == Counter(list(groups))


def test_grace_compares_contents_not_digests(tmp_path):
    records = [["0" * 64, bytes([k % 3]) * 50, [k], 1, (k, k)] for k in range(9)]
    found = list(exact_dedup.grace(iter(records), str(tmp_path), budget=100))
    assert sorted((r[3], r[4]) for r in found) == [(3, (6, 6)), (3, (7, 7)), (3, (8, 8))]
    assert list(tmp_path.iterdir()) == []


def test_sharding(docs, rows):
    found = sharding.shard_rows(docs, [1.0] * 8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def winner(key, weights):
    """The shard with the largest weight / -ln(u), u from chained 64-bit hashes of key and shard."""
    seed = 42 if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
    score = lambda k: weights[k] / -math.log(((xxhash.xxh64_intdigest(k.to_bytes(4, "little"), seed) >> 11) + 0.5) / (1 << 53))
    return max(range(len(weights)), key=lambda k: (score(k), -k))


@pytest.mark.parametrize("weights", [[1.0] * 8, [1.0, 3.0, 0.5]])
def test_shards_equal_brute_force(docs, weights):
    grown = [*weights, sum(weights) / len(weights)]
    for r in sharding.shard_rows(docs, weights).collect():
        assert (r.shard, r.grown_shard) == (winner(r.doc_id, weights), winner(r.doc_id, grown))


def test_weights_give_shares(spark):
    shares = Counter(r[0] for r in spark.range(20_000).select(sharding.rendezvous(F.col("id"), [1.0, 3.0])).collect())
    assert abs(shares[1] / 20_000 - 0.75) < 0.02


def test_bpe_equals_tiktoken(docs, rows):
    coder = tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(MULTI), special_tokens={})
    want = Counter()
    for key, text in rows:
        ids = coder.encode_ordinary(text or "")
        want[key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.encode(docs, MULTI, PATTERN, PATTERN).collect()) == want


def test_bpe_on_random_pieces():
    ranks = bpe.load_ranks(MULTI)
    own, coder, split = bpe.Encoder(ranks), tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), splitter(PATTERN, PATTERN)
    r = random.Random(7)
    parts = ["ab", "é", "  ", "\n", "中", "😀", "'s", "1", "²", "!?", "\x1c", "\x85", "ß", "Ǆ", "a" * 50]
    for _ in range(2_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 15)))
        assert [i for p in split(text) for i in own.encode_piece(p.encode())] == coder.encode_ordinary(text)


def test_packing(docs, rows):
    tokenizer = Tokenizer.from_file(JSON)
    found = packing.pack(docs, JSON, RANKS, PATTERN).collect()
    want, total = Counter(), 0
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        first = len(ids) % 2048 or min(len(ids), 2048)
        for piece, start in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[start : first if piece == 0 else start + 2048]
            want[key, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    places = defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-total // 2048) + 1


def test_sequences_hold_their_documents(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d"), (3, None)], "doc_id long, text string")
    packed = packing.pack(docs, JSON, RANKS, PATTERN, with_ids=True, capacity=6)
    assert sum(len(r.ids) for r in packing.sequences(packed).collect()) == sum(r.length for r in packed.collect())


def optimum(items, capacity):
    best = [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for b in sorted(set(bins)):
            if b + items[k] <= capacity:
                i = bins.index(b)
                go(k + 1, [*bins[:i], b + items[k], *bins[i + 1 :]])
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return best[0]


def test_reduction_never_costs_a_sequence():
    r = random.Random(5)
    for _ in range(150):
        capacity = r.choice([10, 12, 20])
        items = sorted((r.randint(1, capacity) for _ in range(r.randint(1, 9))), reverse=True)
        fixed, left = packing.reduce_instance(Counter(items), capacity)
        rest = sorted((s for s, n in left.items() for _ in range(n)), reverse=True)
        assert sum(n for n, _ in fixed) + (optimum(rest, capacity) if rest else 0) == optimum(items, capacity)


def luhn(digits):
    return sum(x * (1 + k % 2) - 9 * (x * (1 + k % 2) > 9) for k, x in enumerate(map(int, reversed(digits)))) % 10 == 0


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= sum(map(str.isdigit, v)) <= 19 and luhn(re.sub("[^0-9]", "", v))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= sum(map(str.isdigit, v)) <= 15),
}


def base_spans(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in PLAIN.items() for m in re.finditer(p, text) if ok(m[0])]


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_pii(spark, docs, rows):
    r = random.Random(3)
    bits = ["1", "23", "4", ".", "@", "-", " ", "+", "(", ")", "a", "b_", "%", ".c", "4111111111111111", "555", "é"]
    more = spark.createDataFrame([(2_000 + k, "".join(r.choice(bits) for _ in range(r.randint(1, 40)))) for k in range(400)], "doc_id long, text string")
    found = pii.report(docs.select("doc_id", "text").unionByName(more)).collect()
    want = Counter()
    for key, text in [*rows, *((x.doc_id, x.text) for x in more.collect())]:
        spans = base_spans(text or "")
        want[(key, *(sum(s[0] == k for s in spans) for k in PLAIN), hashlib.sha256(listed(spans).encode()).hexdigest())] += 1
    assert Counter(tuple(x)[:6] for x in found) == want
    for x in found:
        if x.doc_id == 10:
            assert set(listed(base_spans(dict(ODD)[10])).split(",")) <= set(x.spans.split(","))


def candidates_of(text):
    """Every candidate with its votes, by plain search."""
    low, search = str.lower, regex.search
    vote = lambda yes, no: -1 if no else 1 if yes else 0
    found = []
    for base, patterns in ((True, {k: p for k, (p, _) in PLAIN.items()}), (False, pii.EXTRA)):
        for kind, pattern in patterns.items():
            matches = [m for m in re.finditer(pattern, text) if not (base and kind == "card") or 16 <= sum(map(str.isdigit, m[0])) <= 19]
            for k, m in enumerate(matches):
                v, digits = m[0], re.sub("[^0-9]", "", m[0])
                before = text[matches[k - 1].end() if k else 0 : m.start()][-pii.CONTEXT :]
                after = text[m.end() : matches[k + 1].start() if k + 1 < len(matches) else len(text)][:2]
                ok = base and PLAIN[kind][1](v)
                words = lambda w: "|".join(w.split())
                gazetteer = {
                    "email": lambda: vote(search(rf"[.)\] ]({words(pii.DOMAINS)})$", low(v)), False), "ip": lambda: vote(False, search(r"^(0|10|127|169\.254|192\.168|255)\.", v)),
                    "card": lambda: vote(search("^(4|5[1-5]|2[2-7]|3[47]|35|6011|65)", digits), search("^[01789]", digits)),
                    "phone": lambda: vote(search(rf"^\+({words(pii.COUNTRIES)})(?![0-9])|^\+1|555", v) if base else search(r"555[.-]", v), search("^0{3}", digits)),
                    "secret": lambda: vote(search(r"[0-9a-f]{32,}$", v), search("[xX*]{8}", v)), "id": lambda: vote(not search("^(000|666|9)", v), search("^(000|666|9)|-00-|-0000$", v)),
                    "name": lambda: vote(search(rf"\b({words(pii.NAMES)})\b", low(v)), False),
                }[kind]()
                shape = {
                    "email": lambda: vote(len(v) <= 254, search(r"\.\.|^\.|@-", v)), "ip": lambda: vote(not search(r"(^|\.)0[0-9]", v), search(r"(^|\.)0[0-9]", v)),
                    "card": lambda: vote(search(r"^([0-9]{4}[\x20-]?){3}[0-9]{4,7}$|^3[47]", v), search(r"^([0-9])\1+$", digits)),
                    "phone": lambda: vote(search(r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-]?[0-9]{4}$", v), search(r"[().\x20-]{4}", v) or search(r"([0-9])\1{7}", digits)),
                    "secret": lambda: vote(search("[0-9]", v) and search("[a-z]", v), not search("[0-9]", v)), "id": lambda: vote(True, search(r"^([0-9])\1+$", digits)), "name": lambda: vote(True, False),
                }[kind]()
                context = vote(search(pii.CUES[kind], low(before)), kind != "secret" and search(pii.AGAINST, low(before)))
                touch = vote(not search(r"[\p{L}0-9]$", before) and not search(r"^[\p{L}0-9]", after), search(r"[0-9]$", before) or search(r"^[0-9]", after))
                found.append({"kind": kind, "base": ok, "start": m.start(), "end": m.end(), "pattern": (1 if ok else -1) if base else 0, "gazetteer": gazetteer, "context": context, "shape": shape, "touch": touch})
    return found


def decided(found, model):
    order, odds = lambda c: (c["start"], -c["end"], pii.KINDS.index(c["kind"])), math.log(pii.SURE / (1 - pii.SURE))
    rest = [c for c in found if not c["base"]]
    score = lambda c: model["bias"][c["kind"]] + sum(w for (n, v), w in model["weight"].items() if c[n] == v)
    free = lambda c: not any(b["base"] and b["start"] < c["end"] and c["start"] < b["end"] for b in found)
    lone = lambda c: not any(order(b) < order(c) and b["end"] > c["start"] for b in rest)
    return [c for c in found if c["base"] or c["pattern"] >= 0 and score(c) > odds and free(c) and lone(c)]


def test_pii_adds_what_the_model_is_sure_of(spark):
    """All spans, base and added, against plain search, plain votes and plain comparison of every two spans."""
    r = random.Random(11)
    bits = ["mail ", "call 212 555-0187", "(305) 555.0123 ", "card 378282246310005", "4111 1111 1111 1111", "4111111111111112 ", "ssn 123-45-6789", "666-12-1234", "token=abcdef0123456789abcdef", "api_key: 'ABCDEFGHIJKLMNOPQR'",
            "Dr. Marie Curie", "Mr Unknown Person ", "ann (at) mail (dot) org", "bob[at]b.co", "a.b@c.de", "8.8.8.8", "10.300.1.1", "+44 20 7946 0958", "+1 212 555 0187", " version 1.2.3.4", ", ", " x ", "9", "é "]
    rows = [(k, "".join(r.choice(bits) for _ in range(r.randint(1, 25)))) for k in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.learn(table.select(pii.candidates(F.col("text")).alias("found")))
    found = {x.doc_id: x.spans for x in pii.report(table).collect()}
    spans = {k: sorted(decided(candidates_of(t), model), key=lambda c: (pii.KINDS.index(c["kind"]), c["start"])) for k, t in rows}
    assert found == {k: ",".join(f"{c['kind']}:{c['start']}:{c['end']}" for c in s) for k, s in spans.items()}
    assert sum(not c["base"] for s in spans.values() for c in s) > 50

    def without(text, spans):
        out, at = "", 0
        for c in sorted(spans, key=lambda c: (c["start"], c["end"], c["kind"])):
            out, at = out + text[at : max(c["start"], at)] + f"[{c['kind'].upper()}]", max(at, c["end"])
        return out + text[at:]

    assert {x.doc_id: x.text for x in pii.redact(table).collect()} == {k: without(t, spans[k]) for k, t in rows}


def test_pii_is_linear_in_a_texts_matches(spark):
    """A hundred thousand matches in one text, some of them added ones, with signs outside the basic plane."""
    n = 50_000
    text = "😀 a.b@c.de 212 555-0187\n" * n
    table = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.monotonic()
    [row] = pii.report(table).collect()
    [clean] = pii.redact(table).collect()
    assert row.n_email == n and row.spans.startswith("email:2:10,email:26:34")
    assert clean.text.count("[EMAIL]") == n and "@" not in clean.text and clean.text.count("😀") == n
    assert time.monotonic() - began < 60


def test_pii_learns_what_the_labelers_agree_on():
    votes = lambda p, g, c, s, t, n: {"kind": "phone", "pattern": p, "gazetteer": g, "context": c, "shape": s, "touch": t, "n": n}
    model = pii.fit([votes(1, 1, 1, 1, 1, 500), votes(-1, -1, -1, -1, -1, 500), votes(1, 1, 0, 1, 1, 300), votes(0, -1, 0, -1, 1, 300), votes(0, 1, 1, 1, 1, 5)])
    score = lambda v: model["bias"]["phone"] + sum(model["weight"].get((n, v[n]), 0.0) for n in pii.LABELERS)
    assert score(votes(0, 1, 1, 1, 1, 1)) > 0 > score(votes(0, -1, -1, -1, -1, 1))
    assert model["reliability"]["pattern"] > 0.9


def test_redaction(spark):
    out = pii.redact(spark.createDataFrame([(1, "mail a@b.co, ip 8.8.8.8!", 0), (2, "clean", 0), (3, None, 0)], "doc_id long, text string, n_chars long"), length_col="n_chars").orderBy("doc_id").collect()
    assert [(r.text, r.n_chars) for r in out] == [("mail [EMAIL], ip [IP]!", 22), ("clean", 5), (None, None)]


def test_quality(docs, rows):
    found = quality.judge(docs, ["doc_id"]).collect()
    want = Counter()
    for key, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines, seen, repeated = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
        for x in lines:
            repeated += x in seen
            seen.add(x)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        twice = Counter(windows)
        covered = {j for i, w in enumerate(windows) if twice[w] > 1 for j in range(i, i + 8)}
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        want[key, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered), failed] += 1
    assert Counter(tuple(r)[:7] for r in found) == want
    assert not any(r.kept and r.base_failed for r in found)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in found)


def test_language_model_is_a_distribution():
    """Kneser-Ney probabilities after any seen context add up to one, and likely text is likelier."""
    keys = np.concatenate([quality.trigrams(t) for t in ["the cat sat on the mat", "the hat that the cat had", "a man at the mill"] * 3])
    grams, counts = np.unique(keys, return_counts=True)
    scorer = quality.Scorer(quality.fit(grams, counts))
    table = scorer(np.arange(1 << 3 * quality.BITS, dtype=np.uint32))
    sums = np.exp(table.reshape(-1, 1 << quality.BITS).astype(float)).sum(1)
    assert np.allclose(sums, 1, atol=1e-4)
    assert table[quality.trigrams("the cat")].mean() > table[quality.trigrams("xq zv")].mean()


class KneserNey:
    """Interpolated modified Kneser-Ney over symbol trigrams, by dictionaries."""

    def __init__(self, trigrams):
        three = Counter(trigrams)
        two = Counter(t[1:] for t in three)
        self.levels = [three, two, Counter(t[1:] for t in two)]
        self.cuts = []
        for level in self.levels:
            n = [0, *(sum(c == k for c in level.values()) for k in (1, 2, 3, 4))]
            if min(n[1:]) == 0:
                self.cuts.append([0, 0.75, 0.75, 0.75])
                continue
            y = n[1] / (n[1] + 2 * n[2])
            raw = [0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
            self.cuts.append([min(max(d, low), high) for d, low, high in zip(raw, [0, 0.05, 0.05, 0.05], [0, 0.95, 1.9, 2.85], strict=True)])
        self.after = []
        for level in self.levels:
            after = defaultdict(list)
            for g, c in level.items():
                after[g[:-1]].append(c)
            self.after.append(after)

    def probability(self, gram, k=0):
        if k == 3:
            return 1 / 256
        lower, after = self.probability(gram[1:], k + 1), self.after[k].get(gram[:-1])
        if not after:
            return lower
        cut, c = self.cuts[k], self.levels[k].get(gram, 0)
        return (c - cut[min(c, 3)]) / sum(after) + sum(cut[min(x, 3)] for x in after) / sum(after) * lower


def test_quality_equals_brute_force(spark, docs, rows):
    """kept and perplexity, from models, medians and deviations made by plain loops."""
    listing = [(r.doc_id, r.text or "", r.lang if r.lang is not None else "\0null") for r in docs.collect()]
    grams = lambda t: [(int(k) >> 16, int(k) >> 8 & 255, int(k) & 255) for k in quality.trigrams(t)]
    number = Counter(lang for _, _, lang in listing)
    own = lambda lang: lang if number[lang] >= 0.01 * len(listing) else "rest"
    corpus = defaultdict(list)
    for _, text, lang in listing:
        corpus[own(lang)] += grams(text)
    models = {lang: KneserNey(g) for lang, g in corpus.items()}
    memo = {lang: {g: math.log(m.probability(g)) for g in set(corpus[lang])} for lang, m in models.items()}
    logs = [-sum(memo[own(lang)][g] for g in grams(text)) / max(len(grams(text)), 1) for _, text, lang in listing]
    base = {}
    for x in quality.judge(docs, ["doc_id"]).collect():
        base.setdefault((x.doc_id, x.n_words, round(x.perplexity, 4)), []).append(x)
    failed = [quality.base_metrics(t)[0] < 20 or 100 * quality.base_metrics(t)[4] > 30 * quality.base_metrics(t)[0] for _, t, _ in listing]
    middle = lambda values: sorted(values)[-(-len(values) // 2) - 1] if values else 0
    mid, dev = {}, {}
    for lang in models:
        inside = [(v, len(grams(t))) for v, (_, t, k), f in zip(logs, listing, failed, strict=True) if own(k) == lang and not f]
        mid[lang] = middle([v for v, _ in inside])
        dev[lang] = middle([abs(v - mid[lang]) * math.sqrt(n) for v, n in inside]) if inside else math.inf
    want = Counter()
    for (key, text, lang), v, f in zip(listing, logs, failed, strict=True):
        k = own(lang)
        want[key, quality.base_metrics(text)[0], round(math.exp(v), 4), not f and abs(v - mid[k]) <= quality.WIDTH * max(dev[k] / math.sqrt(max(len(grams(text)), 1)), quality.LEAST_DEVIATION)] += 1
    found = Counter((x.doc_id, x.n_words, round(x.perplexity, 4), x.kept) for g in base.values() for x in g)
    order = lambda c: sorted(c.elements(), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    for f, w in zip(order(found), order(want), strict=True):
        assert f[:2] == w[:2] and f[3] == w[3] and f[2] == pytest.approx(w[2], rel=1e-4)
    assert any(f[3] for f in found) and any(not f[3] for f in found)


def test_quality_rejects_other_languages_and_noise(spark):
    r = random.Random(1)
    vocabulary = ["".join(r.choice("aeiostrn") for _ in range(r.randint(2, 7))) for _ in range(40)]
    clean = [(k, " ".join(r.choice(vocabulary) for _ in range(150)), "en") for k in range(120)]
    noise = [(500, " ".join("".join(chr(r.randint(0x21, 0x17E)) for _ in range(9)) for _ in range(80)), "en"), (501, "a " * 19 + "aaaa" * 500, "en")]
    found = {x.doc_id: x.kept for x in quality.judge(spark.createDataFrame([*clean, *noise], "doc_id long, text string, lang string"), ["doc_id"]).collect()}
    assert all(found[k] for k, *_ in clean) and not any(found[k] for k, *_ in noise)


def test_quality_bands_follow_length_and_distribution(spark):
    """Junk that a wide band keeps goes, long or short; clean texts stay at every length."""
    r = random.Random(2)
    vocabulary = ["".join(r.choice("aeiostrn") for _ in range(r.randint(2, 7))) for _ in range(60)]
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    clean = [(k, " ".join(prose(r.choice([25, 60, 150, 600]))), "en") for k in range(200)]
    junk = [(500, " ".join(w + r.choice(["###", "&&&"]) * (k % 12 == 0) for k, w in enumerate(prose(600))), "en"), (501, " ".join(w + "$" * (k % 2) for k, w in enumerate(prose(22))), "en")]
    found = {x.doc_id: x for x in quality.judge(spark.createDataFrame([*clean, *junk], "doc_id long, text string, lang string"), ["doc_id"]).collect()}
    assert all(found[k].kept for k, *_ in clean)
    assert not any(found[k].base_failed or found[k].kept for k, *_ in junk)


def test_quality_agrees_with_labels(spark):
    """Of labelled documents that pass the base rules, most junk goes and few clean ones do."""
    d = Path("/root/testdata/sf0.01")
    if not d.is_dir():
        pytest.skip("no tables")
    judged = quality.judge(spark.read.parquet(f"{d}/documents.parquet"), ["doc_id"]).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("not base_failed")
    share = {x.quality: x.share for x in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[0] < 0.4 and share[1] > 0.97


def test_other_scripts_keep_their_letters():
    for first, n in ((0x430, 32), (0x3B1, 25), (0x5D0, 27)):
        assert len({int(quality.trigrams(chr(first + k))[0]) for k in range(n)}) == n
    assert (quality.trigrams("ПРИВЕТ") == quality.trigrams("привет")).all()


def test_urls(spark):
    canonical, refresh = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    pages = [
        (1, "http://a.org/x", canonical.format("https://shop.example.com/en/1")), (2, "https://b.org/y?q=1#z", refresh.format("http://a.org/x")), (3, "http://www.example.com/en/k", canonical.format("http://a.org/x")),
        (4, "http://c.org/", canonical.format("/other")), (5, "http://c.org/other", ""), (6, None, canonical.format("http://a.org/x")), (7, "nohost", None), (8, "http://d.net/es/1", None), (9, "HTTP://A.org/x", "<LINK HREF=/dup REL=canonical>"),
        (10, "http://a.org/dup", None), (11, "http://EXAMPLE.com/en/", ""), (12, "http://examplE.com?x=/en/", ""), (12, "http://examplE.com?x=/en/", ""), (None, "http://e.net/fr/", None),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"host": F.lit(1), "rule": F.lit(2)})
    found = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(table, URL_RULES).orderBy(F.col("page_id").asc_nulls_last()).collect()]
    assert found == [
        (1, "a.org", "/x", None, "block"), (2, "b.org", "/y", None, "block"), (3, "www.example.com", "/en/k", "www.example.com/en/", "allow"), (4, "c.org", "/", None, "allow"), (5, "c.org", "/other", None, "allow"),
        (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "d.net", "/es/1", "net/es/", "block"), (9, "a.org", "/x", None, "block"), (10, "a.org", "/dup", None, "block"), (11, "example.com", "/en/", "example.com/en/", "block"),
        (12, "example.com", "", None, "allow"), (12, "example.com", "", None, "allow"), (None, "e.net", "/fr/", "net/fr/", "block"),
    ]
    con = duckdb.connect()
    con.register("listed", pd.DataFrame(pages, columns=["page_id", "url", "html"]))
    con.execute("CREATE VIEW pages AS SELECT page_id, url, html FROM listed")
    by_sql = con.execute(oracle_sql()["op7_redirect_url_filter"]).fetchall()
    assert Counter(r[1:] for r in by_sql) == Counter(r[1:] for r in found)  # pandas makes floats of ids with a null
    many = [*URL_RULES, *(("block", f"h{k}.example", "/") for k in range(200))]
    assert [tuple(r) for r in url_filter.judge(table, many).orderBy("page_id", "host").collect()] == [tuple(r) for r in url_filter.judge(table, URL_RULES).orderBy("page_id", "host").collect()]


def test_archives(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    odd = [(-1, None, None), (None, "http://a b/\nü", ""), (-5, "x", "HTTP\r\n\r\nWARC/1.1\r\n\r\n"), (-5, "x", "HTTP\r\n\r\nWARC/1.1\r\n\r\n"), (-6, "y", "z" * 300_000)]
    pages = pages.unionByName(pages.limit(9).withColumn("page_id", F.col("page_id") + 5_000)).unionByName(spark.createDataFrame(odd, pages.schema)).withColumns({"number": F.lit(1), "value": F.lit("v")}).cache()
    best, seen, want = {}, set(), Counter()
    listing = pages.collect()
    for r in listing:
        best[r.html or ""] = max(best.get(r.html or "", low(None)), low(r.page_id))
    for r in listing:
        text = r.html or ""
        first = best[text] == low(r.page_id) and text not in seen
        seen |= {text} if first else set()
        to = None if first or best[text] == low(None) else best[text]
        want[r.page_id, len(text.encode()), base64.b32encode(hashlib.sha1(text.encode()).digest()).decode(), "response" if first else "revisit", to] += 1
    assert Counter(tuple(r) for r in warc.archive(pages).collect()) == want


def test_foreign_archives(spark, tmp_path):
    """Hand-made ARC 1 and ARC 2 files, by no means of this library's making."""
    plain, wide = b"HTTP/1.0 200 OK\r\n\r\n", b"HTTP/1.1 200 OK\r\nX-Long: " + b"a" * 100_000 + b"\r\n\r\n"
    body = b"\xff\xfe not utf-8 \n\n http://x.com/ 1.2.3.4 20010101000000 text/html 5\n"
    version = b"1 0 Crawler\nURL IP-address Archive-date Content-type Archive-length\n"
    one = b"filedesc://one.arc 0.0.0.0 19960923142103 text/plain %d\n%s\n\n" % (len(version), version)
    two = warc.arc_version_block(2, "two.arc")
    with pytest.raises(ValueError, match="shorter"):
        list(warc.read_arc(two + b"http://x.com/ 1.2.3.4 20010101000000 text/html 200 - - 0 two.arc 9\nHTTP"))
    first = [(b"http://x.com/a b 1.2.3.4 20010101000000 text/html %d\n", plain + body), (b"dns:x.com 1.2.3.4 200101 text/dns %d\n", b"x.com A 1.2.3.4"), (b"http://bare.com/ 1.2.3.4 never text/html %d\n", body)]
    second = [(b"http://y.com/ 1.2.3.4 20010102030405 text/html 200 - - 0 two.arc %d\n", wide + body), (b"http://z.com/ 1.2.3.4 20010102030405 text/html 200 - - 0 two.arc %d\n", b"HTTP/1.0 200 OK\nA: b\n\nother")]
    (tmp_path / "one.arc").write_bytes(one + b"\n".join(h % len(c) + c for h, c in first) + b"\n")
    (tmp_path / "two.arc.gz").write_bytes(b"".join(gzip.compress(x + b"\n") for x in [two, *(h % len(c) + c for h, c in second)]))
    assert [fields["URL"] for _, fields, _ in warc.read_arc((tmp_path / "one.arc").read_bytes())] == ["http://x.com/a b", "dns:x.com", "http://bare.com/"]
    warc.convert(spark, str(tmp_path), str(tmp_path / "out"), names="*.arc*")
    found = {r.url: r for r in warc.read_back(spark, str(tmp_path / "out")).collect()}
    assert {u: r.record_type for u, r in found.items()} == {"http://x.com/a b": "revisit", "dns:x.com": "resource", "http://bare.com/": "resource", "http://y.com/": "response", "http://z.com/": "response"}
    assert found["http://x.com/a b"].refers_to_id == found["http://y.com/"].record_id
    assert all(r.key is None and r.refers_to is None for r in found.values())
    assert {u: r.payload_bytes for u, r in found.items()} == {"http://x.com/a b": len(body), "dns:x.com": 15, "http://bare.com/": len(body), "http://y.com/": len(body), "http://z.com/": 5}
    text = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "out").glob("part-*"))
    assert re.findall(rb"WARC-Target-URI: dns:.*?WARC-Date|WARC-Date: (.*)\r\nWARC-Target-URI: dns", text) == [b"2001-01-01T00:00:00Z"]
    assert b"WARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: http://bare.com/" in text


def test_archives_are_bounded(spark):
    """A task rolls on to new archives, each with its own version block."""
    pages = spark.range(60).select(F.col("id").alias("page_id"), F.lit("http://a.org/").alias("url"), F.repeat(F.sha2(F.col("id").cast("string"), 256), F.lit(20_000)).alias("html")).coalesce(1)
    path = new_path(spark, "arcs")
    warc.write_arc(pages, path)
    sizes = [len(gzip.decompress(bytes(r.content))) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()]
    assert len(sizes) > 1 and max(sizes) <= (warc.CHUNK + 1_300_000) * warc.ARCHIVE_CHUNKS
    found = warc.archive(pages)
    assert found.count() == 60 and found.filter("record_type = 'response'").count() == 60


@pytest.mark.parametrize("name", ["dedup", "shard", "bpe", "pack", "pii", "redact", "quality", "good", "urls", "warc"])
def test_empty_tables(spark, name):
    d = spark.createDataFrame([], "doc_id long, text string, lang string, n_chars long")
    p = spark.createDataFrame([], "page_id long, url string, html string")
    made = {
        "dedup": lambda: exact_dedup.decisions(d), "shard": lambda: sharding.shard_rows(d, [1.0] * 8), "bpe": lambda: bpe.encode(d, MULTI, PATTERN, PATTERN), "pack": lambda: packing.pack(d, JSON, RANKS, PATTERN),
        "pii": lambda: pii.report(d), "redact": lambda: pii.redact(d), "quality": lambda: quality.judge(d, ["doc_id"]), "good": lambda: quality.keep_good(d), "urls": lambda: url_filter.judge(p, URL_RULES), "warc": lambda: warc.archive(p),
    }[name]()
    assert made.collect() == []
