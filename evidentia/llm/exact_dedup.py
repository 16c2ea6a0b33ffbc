"""Exact deduplication by Grace hashing.

1. Each input task folds its own repeats (a bounded table, flushed when full), so a text that
   a third of all rows share crosses the shuffle once per task, not once per row.
2. The folded records are dealt by digest to partitions, each of which is a Grace bucket.
   Within a task a bucket that outgrows its memory budget is partitioned again, by further
   digits of the digest, to spill files in the task's scratch folder (removed as it ends, rebuilt
   by a retry), until each part fits an open-addressing table that compares whole contents.
3. A narrow join carries each class's outcome back to its rows.

Null text counts as empty.  A null id is smaller than any other.  Of rows that repeat both id
and text, one is kept.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialise, utf8

#: Bytes of text that a table holds before it is flushed (map side) or partitioned (Grace side).
TABLE_BYTES = 48 << 20
#: Spill files for one round of partitioning; a hexadecimal digit of the digest chooses.
FANOUT = 16
LOWEST = -(1 << 63)


class OpenTable:
    """Open addressing with linear probing; equal means equal contents, not equal digests."""

    def __init__(self, gather: bool = True) -> None:
        """gather: a class keeps the payloads of all its records, else that of its best one."""
        self.slots = np.full(1024, -1, np.int64)
        self.entries: list[list] = []  # [digest, text, payloads, size, best (id, uid)]
        self.bytes = 0
        self.gather = gather

    def add(self, record: list) -> list:
        """Fold the record into its class; returns the class."""
        digest, text, reps, size, best = record
        mask = len(self.slots) - 1
        at = int(digest[:15], 16) & mask
        while (k := self.slots[at]) >= 0:
            entry = self.entries[k]
            if entry[1] == text:
                if self.gather:
                    entry[2] += reps
                elif best > entry[4]:
                    entry[2] = list(reps)
                entry[3] += size
                entry[4] = max(entry[4], best)
                return entry
            at = (at + 1) & mask
        self.slots[at] = len(self.entries)
        self.entries.append([digest, text, list(reps), size, best])
        self.bytes += len(text) + 200
        if 2 * len(self.entries) > len(self.slots):
            self._grow()
        return self.entries[-1]

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for k, entry in enumerate(self.entries):
            at = int(entry[0][:15], 16) & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def _read(path: str) -> Iterator[list]:
    with open(path, "rb") as file:
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return


def grace(records: Iterator[list], scratch: str, budget: int = TABLE_BYTES, depth: int = 16, gather: bool = True) -> Iterator[list]:
    """Classes of equal records.  depth: which digit of the digest the next partitioning looks at."""
    table = OpenTable(gather)
    for record in records:
        table.add(record)
        if table.bytes <= budget or len(table.entries) == 1 or depth >= 64:
            continue
        paths = [os.path.join(scratch, f"{depth}-{k}") for k in range(FANOUT)]
        files = [open(p, "wb") for p in paths]
        try:
            for more in (table.entries, records):
                for r in more:
                    pickle.dump(r, files[int(r[0][depth], 16)])
        finally:
            for file in files:
                file.close()
        del table
        for path in paths:
            yield from grace(_read(path), scratch, budget, depth + 1, gather)
            os.remove(path)
        return
    yield from table.entries


def _fold_task(names: list[str], budget: int):
    """Map side: every row becomes a narrow member row; each distinct text one record of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        made, row, table = 0, 0, OpenTable()
        schema = None

        def flushed() -> list[dict]:
            return [{"rep": e[2][0], "digest": e[0], "content": e[1], "size": e[3], "best_id": e[4][0], "best_uid": e[4][1]} for e in table.entries]

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text")).to_pylist()
            ids = batch.column(batch.schema.get_field_index("__id")).to_pylist()
            reps, uids, digests = [], [], []
            for i, text in zip(ids, texts, strict=True):
                digest, uid = hashlib.sha256(text).hexdigest(), base + row
                row += 1
                entry = table.add([digest, text, (), 1, (LOWEST if i is None else i, uid)])
                if not entry[2]:
                    entry[2].append(base + made)
                    made += 1
                reps.append(entry[2][0])
                uids.append(uid)
                digests.append(digest)
            rest = [batch.column(batch.schema.get_field_index(n)) for n in names]
            n = len(ids)
            nothing = [pa.nulls(n, t) for t in (pa.binary(), pa.int64(), pa.int64(), pa.int64())]
            out = pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(digests, pa.string()), pa.array(uids, pa.int64()), *nothing, *rest], ["rep", "digest", "uid", "content", "size", "best_id", "best_uid", *names])
            schema = out.schema
            yield out
            if table.bytes > budget:
                yield from _records(flushed(), schema)
                table = OpenTable()
        if table.entries:
            yield from _records(flushed(), schema)

    return run


def _records(rows: list[dict], schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    part, held = [], 0
    for r in rows:
        part.append(r)
        held += len(r["content"])
        if held > most:
            yield pa.RecordBatch.from_pylist(part, schema)
            part, held = [], 0
    if part:
        yield pa.RecordBatch.from_pylist(part, schema)


def _grace_task(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[list]:
            for batch in batches:
                for r in batch.to_pylist():
                    yield [r["digest"], r["content"], [r["rep"]], r["size"], (r["best_id"], r["best_uid"])]

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["rep", "keep", "keep_uid", "group_size"])

        rows: list[tuple] = []
        with tempfile.TemporaryDirectory() as scratch:
            for _, _, reps, size, (keep, uid) in grace(records(), scratch, budget):
                rows += [(rep, None if keep == LOWEST else keep, uid, size) for rep in reps]
                if len(rows) > 100_000:
                    yield out(rows)
                    rows = []
        if rows:
            yield out(rows)

    return run


def _survivors(names: list[str], budget: int, source: bool):
    """Both sides of keep_one.  source: rows come in, and each distinct text of the task goes out with
    the row that it would keep; else such records come in, and the rows that are kept go out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []
        base, row = TaskContext.get().partitionId() << 40, 0

        def out(entries: list[list]) -> pa.RecordBatch:
            rest = [pa.array(c, t) for c, t in zip(zip(*(e[2][0] for e in entries), strict=True), types, strict=True)] if names else []
            own = [pa.array([e[0] for e in entries], pa.string()), pa.array([e[1] for e in entries], pa.binary()), pa.array([e[4][0] for e in entries], pa.int64()), pa.array([e[4][1] for e in entries], pa.int64())]
            return pa.RecordBatch.from_arrays([*own, *rest], ["digest", "content", "best_id", "best_uid", *names])

        def parts(entries: Iterator[list]) -> Iterator[pa.RecordBatch]:
            some, held = [], 0
            for e in entries:
                some.append(e)
                held += len(e[1])
                if held > 8 << 20:
                    yield out(some)
                    some, held = [], 0
            if some:
                yield out(some)

        def records() -> Iterator[list]:
            nonlocal row
            for batch in batches:
                field = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
                types[:] = [field[n].type for n in names]
                rest = list(zip(*(field[n].to_pylist() for n in names), strict=True)) if names else [()] * len(batch)
                texts = field["content"].to_pylist()
                if source:
                    for text, key, r in zip(texts, field["id"].to_pylist(), rest, strict=True):
                        yield [hashlib.sha256(text).hexdigest(), text, [r], 1, (LOWEST if key is None else key, base + row)]
                        row += 1
                else:
                    for digest, text, key, uid, r in zip(field["digest"].to_pylist(), texts, field["best_id"].to_pylist(), field["best_uid"].to_pylist(), rest, strict=True):
                        yield [digest, text, [r], 1, (key, uid)]

        if source:
            table = OpenTable(gather=False)
            for record in records():
                table.add(record)
                if table.bytes > budget:
                    yield from parts(iter(table.entries))
                    table = OpenTable(gather=False)
            yield from parts(iter(table.entries))
        else:
            with tempfile.TemporaryDirectory() as scratch:
                yield from parts(grace(records(), scratch, budget, gather=False))

    return run


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, budget: int = TABLE_BYTES) -> DataFrame:
    """One row per row of docs: the carried columns, keep_id, group_size, kept, text_sha256.

    carry: columns of docs to pass through (default the id); id_col must be an integer."""
    inner = {c: f"c{k}_" for k, c in enumerate([id_col] if carry is None else carry)}  # names that can't clash
    kinds = dict(docs.dtypes)
    fields = "rep long, digest string, uid long, content binary, size long, best_id long, best_uid long"
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), utf8(F.col(f"`{text_col}`")).alias("__text"), *(F.col(f"`{c}`").alias(v) for c, v in inner.items()))
    folded = arrow_map(rows, _fold_task(list(inner.values()), budget), ", ".join([fields, *(f"{v} {kinds[c]}" for c, v in inner.items())]))
    spool = materialise(folded, "grace")  # written once: a retried task can't number its records anew
    records = spool.filter(F.col("content").isNotNull()).select("rep", "digest", "content", "size", "best_id", "best_uid")
    classes = arrow_map(records.repartition(F.col("digest")), _grace_task(budget), "rep long, keep long, keep_uid long, group_size long")
    return spool.filter(F.col("content").isNull()).select("rep", "digest", "uid", *inner.values()).join(classes, "rep").select(
        *(F.col(v).alias(c) for c, v in inner.items()),
        F.col("keep").alias("keep_id"),
        "group_size",
        (F.col("uid") == F.col("keep_uid")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = TABLE_BYTES) -> DataFrame:
    """docs without the rows that repeat another row's text; columns unchanged.

    A record carries the row that its text would keep, so texts cross one shuffle and no join."""
    null = "text is null"
    marked = docs.withColumn(null, F.col(f"`{text_col}`").isNull())
    inner = {c: f"c{k}_" for k, c in enumerate(c for c in marked.columns if c != text_col)}
    kinds, names = dict(marked.dtypes), list(inner.values())
    fields = ", ".join(["digest string, content binary, best_id long, best_uid long", *(f"{v} {kinds[c]}" for c, v in inner.items())])
    rows = marked.select(F.col(f"`{id_col}`").cast("long").alias("id"), utf8(F.col(f"`{text_col}`")).alias("content"), *(F.col(f"`{c}`").alias(v) for c, v in inner.items()))
    folded = arrow_map(rows, _survivors(names, budget, True), fields)
    kept = arrow_map(folded.repartition(F.col("digest")), _survivors(names, budget, False), fields)
    text = F.when(~F.col(inner[null]), F.col("content").cast("string"))
    return kept.select(*(text.alias(c) if c == text_col else F.col(inner[c]).alias(c) for c in docs.columns))
