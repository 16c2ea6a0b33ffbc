"""Exact self-join of documents by the Jaccard similarity of their word n-gram sets, with
set-relation skipping, and the components that the links make.

1. Profile: every text's set is hashed once; equal sets become one set from here on.  A
   fixed-size sketch counts n-grams over the whole corpus; it only orders them, rare before
   common, so errors in it cost time and never a link.
2. Index: a set's first n - ceil(t n) + 1 n-grams in that order must hold one that any linked
   set shares.  Those postings are dealt by n-gram to index lists.
3. Lists are read in order of set size and position in the set.  Index-level skipping: the size
   and the position of a posting bound the overlap that is left, which skips whole blocks of a
   list.  Short lists give all pairs that remain.  Answer-level skipping: in a long list, sets
   are first compared with the list's leader only; those found similar to it take over its
   answers, namely its component.  What the leaders leave apart is compared component by
   component.  Sets that are in different components even then meet block by block, of sets of
   consecutive sizes: blocks whose sizes, positions or components rule out a link are skipped,
   and so no link is lost, but members of one component are never compared.
4. Candidates whose bitmaps differ too much are dropped before any text is moved: a bitmap holds,
   for as many bits as the set has n-grams, how many n-grams fall on each bit, odd or even, and two
   sets differ in at least as many n-grams as their bitmaps do in bits, so no link is lost.
5. What is left is verified on whole sets, recomputed from the texts.  A leader's members come one
   after the other, and as they are much alike, a member's overlap with the leader is derived
   from that of the member before it by the n-grams in which the two differ.

No list is expanded into all its pairs.  Lists of very common n-grams are dealt in parts, and
everything that is done with a long list is dealt by its blocks, so no task gets a whole one.

Null and empty texts, and texts without words, have an empty set and link with nothing.  With
fewer than n words the whole sequence is one n-gram.  Ids are whole numbers; null ids count as the
smallest id.  Repeated rows have equal sets, so they share a component.  Texts are read whole at
any length; other columns, whatever their names, aren't read.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialise, may_hold, sieve, utf8
from .components import components
from .words import window_sets

WORDS = 5
#: Similarity of at least SIMILAR / 100.
SIMILAR = 75
SKETCH_BITS = 25
CHUNKS = 64
CELLS = (1 << SKETCH_BITS) // CHUNKS
#: N-grams that a task counts together.
SKETCH_RUN = 4_000_000
#: Postings of one index partition, on average; and how many of one n-gram stay together.
PARTITION_POSTINGS, LIST_POSTINGS = 1_000_000, 100_000
#: Lists up to this length give all their pairs at once.
SHORT = 8
#: Sets of a long list that are dealt together, in order of size.
BLOCK = 256
#: Candidates that share a leader go to tasks in parts of this many.
LEADER_PART = 256
#: Parts in which a component's sets are dealt.
ROOT_PARTS = 16
MIX = np.uint64(0x9E3779B97F4A7C15)
LOWEST = -(1 << 63)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _set_id(s: np.ndarray, seed: int) -> int:
    return _signed(xxhash.xxh3_64_intdigest(s.tobytes(), seed=seed))


def _bitmap(s: np.ndarray) -> np.ndarray:
    """Whether an odd number of n-grams falls on each of at least as many bits as there are n-grams: a power
    of two, so that a longer bitmap folds to a shorter one."""
    size = max(64, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _profile(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "n", "sid", "check", "bits", "chunk", "sketch"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
        seen: set[int] = set()
        new: list[np.ndarray] = []

        def counted() -> Iterator[pa.RecordBatch]:
            """The cells that n-grams fell into, by chunk: distances between them and their counts."""
            pack = zstandard.ZstdCompressor(level=1).compress
            cells, counts = np.unique((np.concatenate(new) >> np.uint64(64 - SKETCH_BITS)).astype(np.uint32), return_counts=True)
            new.clear()
            cuts = np.searchsorted(cells, np.arange(CHUNKS + 1, dtype=np.int64) * CELLS)
            for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if hi > lo:
                    blob = pack(np.diff(cells[lo:hi], prepend=np.uint32(k * CELLS)).tobytes() + counts[lo:hi].astype(np.uint32).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((None, None, None, None, None, k, blob), kinds, strict=True)], names)

        for batch in batches:
            ns, sids, checks, bits = [], [], [], []
            for s in window_sets((t.lower() for t in batch.column(1).to_pylist()), words):
                sid = _set_id(s, seed)
                ns.append(len(s))
                sids.append(sid if len(s) else None)
                checks.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bits.append(_bitmap(s) if len(s) else None)
                if sid not in seen and len(s):
                    seen.add(sid)
                    new.append(s)
            if len(seen) > 1_000_000:
                seen.clear()
            nothing = [pa.nulls(len(ns), pa.int32()), pa.nulls(len(ns), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip((ns, sids, checks, bits), kinds[1:5], strict=True)), *nothing], names)
            if sum(map(len, new)) > SKETCH_RUN:
                yield from counted()
        if new:
            yield from counted()

    return run


def _sum_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    pack, unpack = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            gaps, counts = np.frombuffer(unpack(blob), np.uint32).reshape(2, -1)
            if k not in total:
                total[k] = np.zeros(CELLS, np.uint64)
            total[k][np.cumsum(gaps, dtype=np.int64)] += counts
    for k, part in total.items():
        level = np.where(part > 0, 1 + np.rint(4 * np.log2(np.maximum(part, 1).astype(np.float64))), 0).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pack(level.tobytes())], pa.binary())], ["chunk", "levels"])


def _unpacked(chunks: dict[int, bytes]) -> np.ndarray:
    """The levels of all cells; chunks that hold nothing aren't sent."""
    levels = np.zeros((CHUNKS, CELLS), np.uint8)
    for k, blob in chunks.items():
        levels[k] = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return levels.reshape(-1)


def _ordered(s: np.ndarray, levels: np.ndarray, floor: int) -> np.ndarray:
    """The set in the common order: by the sketch's count where it stands out (8 bits), then by hash."""
    level = levels[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    common = np.where(level > floor, level - floor, 0).astype(np.uint64)
    return np.sort(common << np.uint64(56) | (s * MIX) >> np.uint64(8))


def _need(n: np.ndarray | int, m: np.ndarray | int, similar: int):
    """The least overlap of linked sets of n and m: 100 o >= similar (n + m - o)."""
    return -(-(similar * (n + m)) // (100 + similar))


def _index(words: int, seed: int, sent, floor: int, partitions: int, similar: int, together: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen = _unpacked(sent.value), set()
        pack = zstandard.ZstdCompressor(level=1).compress
        held: list[tuple] = []
        postings = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            token, pos, sid, n, central = (np.concatenate(c) for c in zip(*held, strict=True))
            # an n-gram that is common by the sketch is dealt in parts, by set
            level = (token >> np.uint64(56)).astype(np.int64)
            bound = np.exp2(np.where(level > 0, (level + floor) / 4, 0))
            parts = np.maximum(1, np.ceil(bound / together)).astype(np.uint64)
            mixed = (token ^ (token >> np.uint64(31))) * MIX
            part = sid.view(np.uint64) % parts
            p = (((mixed + part * MIX) >> np.uint64(20)) % np.uint64(partitions)).astype(np.int64)
            order = np.lexsort((sid, p))
            # within a partition 32 bits tell n-grams apart; if they don't, lists only grow
            token, pos, sid, n, central, split, p = (x[order] for x in (mixed.astype(np.uint32), pos, sid, n, central, parts > 1, p))
            cuts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            ends = np.r_[cuts[1:], len(p)]
            for lo in range(0, len(cuts), 256):
                blobs = [pack(b"".join(x[s:e].tobytes() for x in (token, sid, n, pos, central, split))) for s, e in zip(cuts[lo : lo + 256], ends[lo : lo + 256], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(p[cuts[lo : lo + 256]], pa.int32()), pa.array((ends - cuts)[lo : lo + 256], pa.int32()), pa.array(blobs, pa.binary())], ["p", "size", "postings"])

        for batch in batches:
            for s in window_sets((t.lower() for t in batch.column(0).to_pylist()), words):
                sid = _set_id(s, seed)
                if not len(s) or sid in seen:
                    continue
                seen.add(sid)
                n = len(s)
                ordered = _ordered(s, levels, floor)
                first = ordered[: n - -(-similar * n // 100) + 1]
                k = len(first)
                # how much of the set others have too: the original of many variants leads them
                central = 255 * int((ordered >> np.uint64(56) > 0).sum()) // n
                held.append((first, np.arange(k, dtype=np.uint32), np.full(k, sid, np.int64), np.full(k, n, np.uint32), np.full(k, central, np.uint8)))
                postings += k
            if postings > 600_000:
                yield from flushed()
                held, postings = [], 0
            if len(seen) > 1_000_000:
                seen.clear()
        if held:
            yield from flushed()

    return run


def _pairs(similar: int, shortest: int, block_sets: int):
    """Index lists to candidate pairs; members of long lists also as (list, set, size)."""

    def lists(p: int, blobs: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        columns: list[list[np.ndarray]] = [[], [], [], [], [], []]
        unpack = zstandard.ZstdDecompressor().decompress
        for size, blob in blobs:
            raw, at = unpack(blob), 0
            for column, kind in zip(columns, ("<u4", "<i8", "<u4", "<u4", "u1", "?"), strict=True):
                column.append(np.frombuffer(raw, kind, size, at))
                at += size * np.dtype(kind).itemsize
        token, sid, n, pos, central, split = (np.concatenate(c) for c in columns)
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        order = np.lexsort((sid, n, token))
        token, sid, n, pos, central, split = (x[order] for x in (token, sid, n, pos, central, split))
        # the same set from several tasks
        fresh = np.r_[True, (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])]
        token, sid, n, pos, central, split = (x[fresh] for x in (token, sid, n, pos, central, split))
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        sizes = np.diff(np.r_[starts, len(token)])
        # the smaller set of a linked pair shares one of its first n - need(n, n) + 1
        small = pos <= n - _need(n, n, similar)
        found_a, found_b = [], []

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            """Postings i and j of one list, i not larger than j."""
            ok = small[i] & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= _need(n[i], n[j], similar)) & (100 * n[i] >= similar * n[j])
            found_a.append(sid[i[ok]])
            found_b.append(sid[j[ok]])

        for gap in range(1, shortest):  # all pairs of short lists: each posting with the gap-th after it
            of = starts[(sizes > gap) & (sizes <= shortest)]
            many = sizes[(sizes > gap) & (sizes <= shortest)] - gap
            if len(of):
                i = np.repeat(of, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                keep(i, i + gap)
        long = np.repeat(sizes > shortest, sizes) | split  # parts of one list meet again later
        for s, k in zip(starts[sizes > shortest].tolist(), sizes[sizes > shortest].tolist(), strict=True):
            span = np.arange(s, s + k)
            lead = span[np.lexsort((sid[span], -central[span].astype(np.int64)))[0]]
            # sizes are in order: the blocks that can't reach the leader's size are skipped
            lo, hi = np.searchsorted(n[span], [-(-similar * n[lead] // 100), 100 * n[lead] // similar + 1])
            rest = span[lo:hi]
            rest = rest[rest != lead]
            keep(rest[rest < lead], np.full((rest < lead).sum(), lead))
            keep(np.full((rest > lead).sum(), lead), rest[rest > lead])
        if found_a and sum(map(len, found_a)):
            a, b = np.concatenate(found_a), np.concatenate(found_b)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            for lo in range(0, len(pairs), 100_000):
                part = pairs[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1]), *(pa.nulls(len(part), pa.int64()) for _ in range(5))], ["a", "b", "list", "block", "n", "pos", "central"])
        if long.any():
            # lists keep their n-gram's name, under which their parts meet again
            block = p << 32 | (np.arange(len(token)) - np.repeat(starts, sizes)) // block_sets
            columns = (x[long].astype(np.int64) for x in (token, block, n, pos, central))
            member = pa.array(sid[long])
            yield pa.RecordBatch.from_arrays([member, pa.nulls(len(member), pa.int64()), *map(pa.array, columns)], ["a", "b", "list", "block", "n", "pos", "central"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blobs = None, []
        for batch in batches:
            for p, size, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if p != at and blobs:
                    yield from lists(at, blobs)
                    blobs = []
                at = p
                blobs.append((size, blob))
        if blobs:
            yield from lists(at, blobs)

    return run


def _gain(leader: np.ndarray, before: np.ndarray, s: np.ndarray) -> int:
    """By how much s shares more with the leader than the set before did: only where the two differ counts."""
    other = np.setxor1d(before, s, assume_unique=True)
    shared = other[leader[np.minimum(np.searchsorted(leader, other), len(leader) - 1)] == other]
    new = (s[np.minimum(np.searchsorted(s, shared), len(s) - 1)] == shared).sum()
    return int(2 * new - len(shared))


def _verify(words: int, seed: int, similar: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leader, before, both = None, None, None, 0
        for batch in batches:
            a, b = [], []
            sets = window_sets((t.lower() for t in batch.column(3).to_pylist()), words)
            for lead, part, member, s in zip(*(batch.column(k).to_pylist() for k in range(3)), sets, strict=True):
                if _set_id(s, seed) != (lead if member is None else member):
                    continue  # another text under the same document id
                if member is None:
                    at, leader, before, both = (lead, part), s, s, len(s)
                elif at == (lead, part):
                    both += _gain(leader, before, s)
                    before = s
                    if 100 * both >= similar * (len(leader) + len(s) - both):
                        a.append(lead)
                        b.append(member)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


class _Join:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, words: int, similar: int) -> None:
        self.words, self.similar, self.seed = words, similar, 0
        self.rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LOWEST)).alias("key"), utf8(F.col(f"`{text_col}`")).alias("text"))
        self.spark = docs.sparkSession

    def profile(self) -> None:
        """sets: one row per distinct set; should two sets ever share an id, all ids are drawn anew."""
        while True:
            table = materialise(arrow_map(self.rows, _profile(self.words, self.seed), "key long, n int, sid long, check binary, bits array<long>, chunk int, sketch binary"), "profile")
            self.documents = table.filter(F.col("chunk").isNull()).select("key", "n", "sid", "check")
            by_set = table.filter(F.col("sid").isNotNull()).groupBy("sid").agg(F.min("key").alias("key"), F.first("n").alias("n"), (F.min("check") != F.max("check")).alias("clash"), F.first("bits").alias("bits"))
            self.sets = materialise(by_set, "sets")
            total = self.sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max(F.col("clash")), F.lit(False)).alias("clash")).first()
            if not total["clash"]:
                break
            self.seed += 1
        self.total = total["n"]
        chunks = arrow_map(table.filter(F.col("chunk").isNotNull()).select("chunk", "sketch").repartition(CHUNKS, "chunk"), _sum_sketch, "chunk int, levels binary")
        # 2 ** SKETCH_BITS bytes at most, whatever the input; packed here, as only tasks look into them
        self.levels = self.spark.sparkContext.broadcast({row["chunk"]: bytes(row["levels"]) for row in chunks.toLocalIterator()})
        mean = self.total / (1 << SKETCH_BITS)  # counts that stand out of it make an n-gram common
        self.floor = math.ceil(1 + 4 * math.log2(mean + 6 * math.sqrt(mean) + 4))

    def candidates(self) -> None:
        partitions = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.total * (100 - self.similar) // 100 // PARTITION_POSTINGS)
        postings = arrow_map(self.rows.select("text"), _index(self.words, self.seed, self.levels, self.floor, partitions, self.similar, LIST_POSTINGS), "p int, size int, postings binary")
        dealt = postings.repartition(partitions, "p").sortWithinPartitions("p")
        found = materialise(arrow_map(dealt, _pairs(self.similar, SHORT, BLOCK), "a long, b long, list long, block long, n long, pos long, central long"), "candidates")
        self.levels.destroy()  # else the driver holds it until its collector finds it
        self.pairs = found.filter(F.col("list").isNull()).select("a", "b").distinct()
        self.lists = found.filter(F.col("list").isNotNull()).select("list", "block", F.col("a").alias("sid"), "n", "pos", "central")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose bitmaps leave room for a link."""
        side = lambda k: self.sets.select(F.col("sid").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}"))
        rows = pairs.join(side("a"), "a").join(side("b"), "b")
        xor = lambda x, y: F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))

        def folded(c: str, other: str) -> Column:
            half = F.floor(F.size(c) / 2).cast("int")
            return F.when(F.size(c) == 2 * F.size(other), xor(F.slice(c, 1, half), F.slice(c, half + 1, half))).otherwise(F.col(c))

        x, y = folded("bitsa", "bitsb"), folded("bitsb", "bitsa")
        apart = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)
        total = F.col("na") + F.col("nb")
        # linked sets are less than twice as large as each other, so one fold makes their bitmaps alike
        return rows.filter((F.size(x) != F.size(y)) | (F.floor((total - apart) / 2) >= F.ceil(self.similar * total / (100 + self.similar)))).select("a", "b")

    def verify(self, pairs: DataFrame, n: int) -> DataFrame:
        """Of n pairs, those that are links.  The first of a pair leads; a leader with many is repeated by parts.

        Texts that no pair asks for are sieved out before texts and pairs meet by a shuffle."""
        parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / LEADER_PART).cast("int").alias("parts"))
        members = pairs.join(parts, "a").select(F.col("a").alias("lead"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("member"))
        leaders = parts.select(F.col("a").alias("lead"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("member"))
        asked = members.unionByName(leaders).withColumn("sid", F.coalesce("member", "lead"))
        asked = materialise(asked.join(self.sets.select("sid", "key"), "sid").select("key", "lead", "part", "member"), "asked", rows=2 * n)
        wanted = self.rows.filter(may_hold(sieve(asked, "key").scalar(), "key"))
        texts = wanted.join(asked.hint("merge"), "key").select("lead", "part", "member", "text")
        dealt = texts.repartition("lead", "part").sortWithinPartitions("lead", "part", F.col("member").asc_nulls_first())
        return materialise(arrow_map(dealt, _verify(self.words, self.seed, self.similar), "a long, b long").distinct(), "links", rows=n)

    def _leads(self, placed: DataFrame) -> DataFrame:
        """In each list, the most central set of every component with that of the list's leading component.

        The leader goes to the blocks that others stand in, so that a list with many components is no hot key."""
        parts = placed.groupBy("list", "root").agg(F.max(F.struct("central", "sid", "n", "pos", "block")).alias("first"))
        head = lambda c, k: [F.col(f"{c}.{x}").alias(f"{x}{k}") for x in ("sid", "n", "pos")]
        lead = parts.groupBy("list").agg(F.max(F.struct("first", "root")).alias("f")).select("list", F.col("f.root").alias("root1"), *head("f.first", 1))
        sent = parts.select("list", F.col("first.block").alias("block")).distinct().join(lead, "list")
        return parts.select("list", F.col("first.block").alias("block"), F.col("root").alias("root2"), *head("first", 2)).join(sent, ["list", "block"]).filter("root1 <> root2")

    def _across(self, placed: DataFrame) -> DataFrame:
        """Pairs from two components of a list, by the pairs of its blocks that sizes, positions and components leave."""
        t = self.similar
        blocks = placed.groupBy("list", "block").agg(
            F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("pos")).alias("ahead"), F.min("root").alias("low"), F.max("root").alias("high"),
            F.min(F.expr(f"pos - n + ceil({t} * 2 * n / {100 + t})")).alias("lead"),
        )
        side = lambda df, k: df.select("list", *(F.col(c).alias(f"{c}{k}") for c in df.columns if c != "list"))
        reach = f"100 * most1 >= {t} * least2 and 100 * most2 >= {t} * least1 and least(ahead1, ahead2) >= ceil({t} * (least1 + least2) / {100 + t}) and least(lead1, lead2) <= 0"
        meet = side(blocks, 1).join(side(blocks, 2), "list").filter(f"block1 <= block2 and least(low1, low2) < greatest(high1, high2) and {reach}").select("list", "block1", "block2")
        member = lambda k: side(placed.drop("central"), k).join(meet, ["list", f"block{k}"])
        return member(1).join(member(2), ["list", "block1", "block2"]).filter("if(block1 < block2, root1 <> root2, root1 < root2)")

    def _open(self, members: DataFrame) -> DataFrame:
        """Members of lists with their components, where a list has several; others are done and never looked at again."""
        placed = members.join(self.labels.withColumnRenamed("v", "sid"), "sid", "left").select("list", "block", "sid", "n", "pos", "central", F.coalesce("root", "sid").alias("root"))
        placed = materialise(placed, "placed")
        apart = placed.groupBy("list").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
        return placed.filter(may_hold(sieve(apart, "list").scalar(), "list"))

    def links(self) -> DataFrame:
        tried = materialise(self.likely(self.pairs), "pairs")
        links = self.verify(tried, tried.count())
        self.labels = components(links)
        placed, final = self._open(self.lists), False
        while not placed.isEmpty():
            more = self._across(placed) if final else self._leads(placed)
            # the bounds of size and position, as in the lists themselves
            t = self.similar
            need = f"ceil({t} * (n1 + n2) / {100 + t})"
            small = "if(n1 < n2 or n1 = n2 and pos1 < pos2, struct(n1 as n, pos1 as pos), struct(n2 as n, pos2 as pos))"
            close = F.expr(f"100 * least(n1, n2) >= {t} * greatest(n1, n2) and least(n1 - pos1, n2 - pos2) >= {need} and {small}.pos <= {small}.n - ceil({t} * 2 * {small}.n / {100 + t})")
            more = more.filter(close).select(F.least("sid1", "sid2").alias("a"), F.greatest("sid1", "sid2").alias("b")).distinct()
            more = materialise(self.likely(more.join(tried, ["a", "b"], "left_anti")), "pairs")
            n = more.count()
            new = self.verify(more, n) if n else None
            if grown := new is not None and not new.isEmpty():
                links = links.unionByName(new)
                self.labels = components(links)
            if final:
                return links  # pairs of what is one component by now were only spared, not lost
            if n:
                tried = tried.unionByName(more)
            if grown:
                placed = self._open(placed.drop("root"))
            final = not grown
        return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (smallest id reachable by links)."""
    join = _Join(docs, id_col, text_col, words, similar)
    join.profile()
    join.candidates()
    join.links()
    # a component's smallest id goes back to its sets in parts: some components are large
    placed = join.sets.join(join.labels.withColumnRenamed("v", "sid"), "sid").select("sid", "key", "root", F.pmod(F.xxhash64("sid"), F.lit(ROOT_PARTS)).cast("int").alias("part"))
    smallest = placed.groupBy("root").agg(F.min("key").alias("component")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(ROOT_PARTS - 1))))
    linked = placed.join(smallest, ["root", "part"]).select("sid", "component")
    by_set = materialise(join.sets.select("sid", "key").join(linked, "sid", "left").select("sid", F.coalesce("component", "key").alias("component")), "classes")
    real = lambda c: F.when(F.col(c) != LOWEST, F.col(c))
    out = join.documents.join(by_set, "sid", "left").select("key", "n", F.coalesce("component", "key").alias("component"))
    return out.select(real("key").alias(id_col), F.col("n").cast("long").alias("n_shingles"), real("component").alias("component_id"))


def keep_smallest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """docs with one row of each component, that with the smallest id (null first); columns unchanged.

    Rows are joined, chosen and dropped by number, as ids may repeat; of equal ids one row stays."""
    number = "row number"
    while number in docs.columns:
        number += "_"
    rows = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")  # written once: a retried task can't number its rows anew
    found = near_duplicates(rows.select(number, text_col), number, text_col, words, similar)
    follow = materialise(found.filter(F.col(number) != F.col("component_id")).select(number, "component_id"), "followers")
    members = follow.unionByName(follow.select(F.col("component_id").alias(number), "component_id").distinct())
    placed = members.join(rows.select(number, F.col(f"`{id_col}`").alias("id")), number)
    first = placed.groupBy("component_id").agg(F.min(F.struct("id", number)).alias("m")).select(F.col("m").getField(number).alias(number))
    extra = materialise(members.select(number).join(first, number, "left_anti"), "extra")
    # most texts aren't dropped and stay where they are; those that the sieve can't tell meet the numbers by a shuffle
    doubtful = may_hold(sieve(extra, number).scalar(), number)
    kept = rows.filter(~doubtful).unionByName(rows.filter(doubtful).join(extra.hint("merge"), number, "left_anti"))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
