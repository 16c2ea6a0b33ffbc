"""Best-fit packing after Martello and Toth's dominance reduction.

Documents are tokenised where they lie, and only (length, place) rows travel.  A packing needs
to know no more of a corpus than how many pieces there are of each length, a table of at most
`capacity` rows whatever the input.  The plan is made from it for all pieces of a length at once:

* reduction: for the largest length j, a set that provably dominates every other feasible set
  with j is fixed, as often as its members last - j alone where nothing fits beside it; j with
  the largest length that fits, where that fills the sequence or at most one more piece fits; j
  with a best pair, or the single piece that is worth it, where at most two more fit;
* best fit, decreasing, of what remains: equal pieces go to the sequences of the least
  sufficient room, so each length splits at most two of the groups of equal sequences.

So the plan has a bounded number of entries (groups times distinct lengths in a sequence), is
broadcast, and tells the r-th piece of a length its sequence and offset.  r comes from counts
by task and length, not from a window over all pieces of a length.

Null and empty texts have one token, the separator.  Repeated rows are packed each.  Only
documents longer than the capacity are cut: every piece but the first is full.  An empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import load_ranks
from .common import arrow_map, materialise

CAPACITY = 2048
SEPARATOR = 0
RANK_BITS = 44

Group = tuple[int, list[tuple[int, int]]]  # how many sequences, and (length, copies) in each


class _Stock:
    """Counts of lengths, with the present lengths in order."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.count = {size: n for size, n in counts.items() if n > 0}
        self.sizes = sorted(self.count)

    def take(self, pattern: Counter, times: int) -> None:
        for size, copies in pattern.items():
            self.count[size] -= copies * times
            if not self.count[size]:
                del self.count[size]
                self.sizes.remove(size)

    def beside(self, j: int, size: int) -> int:
        """How many pieces of that size there are beside one j."""
        return self.count.get(size, 0) - (size == j)

    def smallest(self, j: int, most: int, over: int = 0) -> list[int]:
        out: list[int] = []
        for size in self.sizes[bisect.bisect_right(self.sizes, over) :]:
            out += [size] * min(most - len(out), self.beside(j, size))
            if len(out) == most:
                break
        return out

    def largest(self, j: int, room: int) -> int:
        k = bisect.bisect_right(self.sizes, room) - 1
        while k >= 0 and not self.beside(j, self.sizes[k]):
            k -= 1
        return self.sizes[k] if k >= 0 else 0

    def best_pair(self, j: int, room: int) -> tuple[int, int]:
        """The two pieces beside j whose sum is largest within the room (larger first)."""
        best, lo, hi = (0, 0), 0, len(self.sizes) - 1
        while lo <= hi:
            x, y = self.sizes[hi], self.sizes[lo]
            if x + y > room or not self.beside(j, x):
                hi -= 1
            elif not self.beside(j, y) or x == y and self.beside(j, x) < 2:
                lo += 1
            else:
                best = max(best, (x, y), key=sum)
                lo += 1
        return best


def dominating(stock: _Stock, j: int, capacity: int) -> Counter | None:
    """A set with j that dominates all feasible sets with j, if that can be proved."""
    room = capacity - j
    few = stock.smallest(j, 3)
    if not few or few[0] > room:
        return Counter([j])
    a = stock.largest(j, room)
    if a == room or len(few) < 2 or few[0] + few[1] > room:
        return Counter([j, a])
    if len(few) == 3 and sum(few) <= room:
        return None
    x, y = stock.best_pair(j, room)
    if a >= x + y:
        return Counter([j, a])
    over = stock.smallest(j, 2, over=y)  # a pair that needs more than y in both places?
    if x == a and (len(over) < 2 or sum(over) > room):
        return Counter([j, x, y])
    return None


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[Group], dict[int, int]]:
    """The sequences that are fixed for good, and what is left to pack."""
    stock, fixed, changed = _Stock(counts), [], True
    while changed:
        changed = False
        for j in sorted(stock.count, reverse=True):
            while j in stock.count and (pattern := dominating(stock, j, capacity)):
                times = min(stock.count[size] // copies for size, copies in pattern.items())
                stock.take(pattern, times)
                fixed.append((times, sorted(pattern.items(), reverse=True)))
                changed = True
    return fixed, stock.count


def best_fit(counts: dict[int, int], capacity: int) -> list[Group]:
    """Best fit, decreasing, of all pieces of a length at once."""
    room: dict[int, list[Group]] = defaultdict(list)
    rooms: list[int] = []

    def put(left: int, group: Group) -> None:
        if not room[left]:
            bisect.insort(rooms, left)
        room[left].append(group)

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            k = bisect.bisect_left(rooms, size)
            if k < len(rooms):
                left = rooms[k]
                many, held = room[left].pop()
                if not room[left]:
                    rooms.pop(k)
            else:
                left, many, held = capacity, -(-n // (capacity // size)), []
            each = left // size
            full, rest = min(many, n // each), 0
            if full < many:
                rest = n % each
            if full:
                put(left - each * size, (full, [*held, (size, each)]))
            if rest:
                put(left - rest * size, (1, [*held, (size, rest)]))
            if untouched := many - full - bool(rest):
                put(left, (untouched, held))
            n -= full * each + rest
    return [group for left in rooms for group in room[left]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Entries ordered by key = length and first rank: the r-th piece of a length belongs to the
    last entry whose key is not above (length, r)."""
    fixed, left = reduce_instance(counts, capacity)
    used: Counter = Counter()
    rows, base = [], 0
    for many, pattern in [*fixed, *best_fit(left, capacity)]:
        offset = 0
        for size, copies in pattern:
            rows.append(((size << RANK_BITS) | used[size], base, copies, offset))
            used[size] += many * copies
            offset += size * copies
        base += many
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4).T
    return dict(zip(("key", "base", "copies", "offset"), columns, strict=True)) | {"sequences": np.int64(base)}


def _tokenise(vocabulary: str, ranks: str, pattern: str, special: str, capacity: int, separator: int, with_ids: bool):
    """Pieces of each document, numbered within the task by length.

    The merges are run from the rank file of the same vocabulary, which gives the tokenizers
    library's ids five times as fast; texts with the special token's name are its own to read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from tokenizers import Tokenizer

        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(ranks), special_tokens={})
        own = None
        cell, seen = TaskContext.get().partitionId(), Counter()
        end = np.array([separator], np.uint32)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                if special in text:
                    own = own or Tokenizer.from_file(vocabulary)
                    ids = np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)
                else:
                    ids = fast.encode_to_numpy(text, disallowed_special=())
                ids = np.concatenate([ids, end]).astype("<u4")
                first = len(ids) % capacity or min(len(ids), capacity)
                for piece, start in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[start : first if not piece else start + capacity]
                    n = len(part)
                    rows.append((key, piece, start, n, zlib.crc32(part.tobytes()), cell, seen[n], part.tolist() if with_ids else None))
                    seen[n] += 1
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            names = ["key", "piece", "start", "length", "ids_crc32", "cell", "nth", "ids"]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return run


def _place(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(p["key"], (length << RANK_BITS) | rank, side="right") - 1
            nth = rank - (p["key"][at] & ((1 << RANK_BITS) - 1))
            copies = p["copies"][at]
            out = {"sequence_id": p["base"][at] + nth // copies, "offset": p["offset"][at] + nth % copies * length}
            keep = [i for i, n in enumerate(batch.schema.names) if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *(pa.array(v) for v in out.values())], [*(batch.schema.names[i] for i in keep), *out])

    return run


def pack(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, special: str = "<|endoftext|>", capacity: int = CAPACITY, separator: int = SEPARATOR, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (with_ids: ids).

    vocabulary and ranks: the same vocabulary for the tokenizers library and as a rank file, on
    paths that every worker can read."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").alias("text"))
    task = _tokenise(vocabulary, ranks, pattern, special, capacity, separator, with_ids)
    pieces = materialise(arrow_map(rows, task, f"key {kind}, piece int, start long, length long, ids_crc32 long, cell int, nth long, ids array<long>"), "pieces")
    if not with_ids:
        pieces = pieces.drop("ids")
    cells = pieces.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n"))
    # at most `capacity` rows, whatever the input
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    sent = spark.sparkContext.broadcast(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["length", "cell"]).select("key", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"), *(["ids"] if with_ids else []))
    fields = f"key {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "") + ", sequence_id long, offset long"
    return ranked.mapInArrow(_place(sent), fields).withColumnRenamed("key", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids in order, from pack(..., with_ids=True); a group is one sequence."""
    part = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(part, lambda p: p["ids"])).alias("ids"))
