"""Spelling variants grouped: every word, the words one edit away, the form that it varies and that form's root.

1. Words of a text are counted in its own task, then by task, then over the corpus.
2. Bigrams are ordered by how many words of the vocabulary hold them, rare first.  A word's prefix is its
   three rarest (and all that equal the third): one edit destroys two of them at most.  Two disjoint ones of
   the prefix, the cheapest by dynamic programming, are its pivots: one edit leaves one of them alone.
3. Of two near words, that whose prefix ends earlier has a pivot in the other's prefix.  Pivots are joined to
   prefixes by position: an edit lies on one side of a surviving gram, so the other side is equal and the
   gram's distance from that end too.  Where the equal side is short it would be shared by too many words, so
   the other side's halves are keys as well: one edit leaves one of them alone.
4. Candidates are verified by edit distance, and each word keeps its best near word; forms are followed to
   their roots by pointer doubling.

Null and empty texts have no words; a null key counts as an empty one.  Rows that repeat a key and a text count as often
as they come.  A text of any length is split whole; a run of any length is one word.  Near words of equal count are
taken in code-point order.  An empty table gives no words.  Only the key and the text are read, so columns
of other names don't matter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from struct import pack as packed

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialise

#: Words that a task counts before it passes them on.
HELD = 400_000
#: Rows in one Arrow batch of keys.
BATCH = 1 << 16
#: Code points of an equal side that make a key by themselves.
STRONG = 6

#: Latin-1 letters with A-Z in lower case; everything else is a blank.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def _damaged(word: bytes, start: int, every: int) -> bytes:
    """The word without one letter, where the hash of key and word says so."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
    return word if h % every else word[: (k := h % len(word))] + word[k + 1 :]


def _counted(batches: Iterator[pa.RecordBatch], least: int, every: int) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def flushed() -> Iterator[pa.RecordBatch]:
        words = list(held)
        for k in range(0, len(words), BATCH):
            part = words[k : k + BATCH]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in part], pa.string()), pa.array([held[w] for w in part], pa.int64())], ["word", "n"])
        held.clear()

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            start = zlib.crc32(f"{key}:".encode())
            # characters beyond Latin-1 become question marks, so blanks; the letters' code points are their bytes
            for word, n in Counter((text.as_py() or "").encode("latin-1", "replace").translate(_LETTERS).split()).items():
                if every:
                    word = _damaged(word, start, every)
                if len(word) >= least:
                    held[word] += n
            if len(held) >= HELD:
                yield from flushed()
    yield from flushed()


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 7, twice: int = 2, every: int = 31) -> DataFrame:
    """(word, n): words of that many letters and occurrences.  Every so many-th pair of key and word (by hash)
    loses a letter, which plants misspellings; 0 leaves all alone.  Shorter words than four have no two disjoint bigrams."""
    if least < 4:
        raise ValueError("least must be 4 or more")
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text"))
    found = arrow_map(rows, lambda batches: _counted(batches, least, every), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= twice)


def _symbols(word: bytes) -> np.ndarray:
    """Letters as numbers below 90: 26 and the 64 of Latin-1."""
    x = np.frombuffer(word, np.uint8).astype(np.int16)
    return np.where(x >= 0xC0, x - (0xC0 - 26), x - 97)


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bigrams of all words as numbers below 8,100, and where each word's begin in them; one more at the end."""
    x = _symbols(b"".join(words))
    ends = np.cumsum([len(w) for w in words])
    inside = np.ones(len(x) - 1, bool)
    inside[ends[:-1] - 1] = False
    return (x[:-1] * np.int16(90) + x[1:])[inside], np.concatenate([[0], ends - np.arange(1, len(words) + 1)])


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(8100, np.int64)
    for batch in batches:
        if batch.num_rows:
            total += np.bincount(_grams([w.encode("latin-1") for w in batch.column(0).to_pylist()])[0], minlength=8100)
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], ["gram", "n"])


def bigram_order(words: DataFrame) -> np.ndarray:
    """How often each bigram is in the vocabulary.  There are 8,100 at most, so the driver may hold them."""
    total = np.zeros(8100, np.int64)
    for gram, n in arrow_map(words.select("word"), _bigrams, "gram int, n long").groupBy("gram").agg(F.sum("n")).collect():
        total[gram] = n
    return total


def prefix_and_pivots(costs: list[int], ranks: list[int]) -> tuple[list[int], list[int], int]:
    """Positions of a word's prefix, those of its two pivots, and the rank at which the prefix ends.

    Of three positions the outer two are always disjoint, so pivots exist.  best: the cheapest gram that ends
    before the one looked at, so each step adds the best partner."""
    last = sorted(ranks)[min(2, len(ranks) - 1)]
    prefix = [i for i, r in enumerate(ranks) if r <= last]
    best: list[tuple[int, int]] = []  # the cheapest (cost, position) of the prefix up to each of its grams
    chosen: tuple[int, int, int] | None = None
    free = -1  # index in best of the last gram that is disjoint from the present one
    for i in prefix:
        while free + 1 < len(best) and prefix[free + 1] + 2 <= i:
            free += 1
        if free >= 0 and (chosen is None or best[free][0] + costs[i] < chosen[0]):
            chosen = (best[free][0] + costs[i], best[free][1], i)
        best.append(min(best[-1], (costs[i], i)) if best else (costs[i], i))
    return prefix, list(chosen[1:]) if chosen else prefix, last


def _keys(word: bytes, i: int, pivot: bool) -> Iterator[int]:
    """Keys of the bigram at i: that its left side is equal, or that its right side is.

    Words of equal length meet under the code 0.  Of others a pivot of the shorter meets a prefix of the longer
    under 1, a pivot of the longer a prefix of the shorter under 2."""
    for side, known, rest in ((b"L", word[: i + 2], word[i + 2 :]), (b"R", word[i:][::-1], word[:i][::-1])):
        if len(known) >= STRONG:
            yield xxhash.xxh3_64_intdigest(side + known)
            continue
        n = len(rest)
        for code, short, more in ((0, n, 0), (1 if pivot else 2, n, 0), (2 if pivot else 1, n - 1, 1)):
            if short >= (code == 0):  # the rest of the shorter word
                half = short // 2
                head = packed("<cBII", side, code, len(known), short) + known
                yield xxhash.xxh3_64_intdigest(head + b"n" + rest[:half])
                yield xxhash.xxh3_64_intdigest(head + b"f" + rest[half + more :])


def _indexed(batches: Iterator[pa.RecordBatch], costs: np.ndarray, ranks: np.ndarray, pivot: bool) -> Iterator[pa.RecordBatch]:
    def made(keys: list[int], of: list[int], lasts: list[int], batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.take(pa.array(of, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), rows.column(0), rows.column(1), pa.array(np.array(lasts, np.int32)[of] if of else np.zeros(0, np.int32))], ["key", "word", "n", "last"])

    for batch in batches:
        words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
        if not words:
            continue
        grams, starts = _grams(words)
        cost, rank, cuts = costs[grams].tolist(), ranks[grams].tolist(), starts.tolist()
        keys: list[int] = []
        of: list[int] = []
        lasts: list[int] = []
        for k, word in enumerate(words):
            prefix, pivots, last = prefix_and_pivots(cost[cuts[k] : cuts[k + 1]], rank[cuts[k] : cuts[k + 1]])
            lasts.append(last)
            for i in pivots if pivot else prefix:
                for key in _keys(word, i, pivot):
                    keys.append(key)
                    of.append(k)
            if len(keys) >= BATCH:
                yield made(keys, of, lasts, batch)
                keys, of = [], []
        yield made(keys, of, lasts, batch)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each two words one edit apart, once, in the order that their prefixes end in."""
    costs = bigram_order(words)
    ranks = np.empty(8100, np.int32)
    ranks[np.lexsort((np.arange(8100), costs))] = np.arange(8100)

    def side(name: str, pivot: bool) -> DataFrame:
        rows = arrow_map(words.select("word", "n"), lambda batches: _indexed(batches, costs, ranks, pivot), "key long, word string, n long, last int")
        return rows.select("key", *(F.col(c).alias(f"{name}{c}") for c in ("word", "n", "last")))

    size = F.length("aword") - F.length("bword")
    met = side("a", True).join(side("b", False), "key").filter((F.col("alast") <= F.col("blast")) & size.between(-1, 1) & (F.col("aword") != F.col("bword")))
    near = met.filter(F.levenshtein(F.col("aword"), F.col("bword"), 1) == 1)
    # words whose prefixes end alike find each other twice, and several keys may bring a pair together
    swap = (F.col("alast") == F.col("blast")) & (F.col("aword") > F.col("bword"))
    turned = lambda name: F.when(swap, F.col(f"{'b' if name[0] == 'a' else 'a'}{name[1:]}")).otherwise(F.col(name))
    return near.select(turned("aword").alias("a"), turned("an").alias("a_n"), turned("bword").alias("b"), turned("bn").alias("b_n")).distinct()


def roots(parents: DataFrame, word: str = "word", form: str = "form") -> DataFrame:
    """(word, root) for words that have a form; a form occurs more often than its word, so there are no cycles."""
    found = materialise(parents.select(F.col(word).alias("word"), F.col(form).alias("root")), "forms")
    while True:
        up = found.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        found = materialise(found.join(up, "root", "left").select("word", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "roots")
        if found.filter("moved").isEmpty():
            return found.select("word", "root")
        found = found.select("word", "root")


def group_variants(words: DataFrame, times: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a vocabulary (word, n): the form is the near word that occurs
    most often, if it does so that many times as often as the word itself."""
    pairs = near_pairs(words)
    both: Column = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    best = pairs.select(both.alias("p")).select("p.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    joined = words.select("word", "n").join(best, "word", "left")
    varies = F.col("best.less") <= -times * F.col("n")
    rows = joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(varies, F.col("best.near")).alias("form"), F.when(varies, -F.col("best.less")).alias("form_n"))
    rows = materialise(rows, "variants")
    return rows.join(roots(rows.filter(F.col("form").isNotNull())), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Words of the texts with their variants, by the stated parameters."""
    return group_variants(materialise(vocabulary(docs, key, text), "vocabulary"))
