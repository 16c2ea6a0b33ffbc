"""What streams remember of stories and events (STRM-7, 8): keyed state that ends by itself."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import EngineConfig

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, on the executors' disks rather than in their heaps;
    what the session had set before holds again afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: Parts of the state: events and stories are dealt to them by their ids, so that a batch is some calls with many of them, not
#: one a call.  A prime, so that ids in steps of two or ten are spread too.
SHARDS = 1021
HELD, CHANGES = "rows binary, statuses array<string>", "story long, micros long, before string, after string, recent int"
#: A story without an id.
NO_STORY = -(1 << 63)


def _one_by_one(at: np.ndarray, code: np.ndarray, fresh: np.ndarray, keep: int) -> tuple[list[tuple[int, int]], list[int]]:
    """(place, recent) of the entries of a story whose updates aren't in order, and the places that stay."""
    last, times, found = None, [], []
    for k, now in enumerate(at.tolist()):
        if not fresh[k]:
            last = now if last is None else max(last, now)
            times.append(k)
            continue
        alone = last is None or now - last > keep
        times = [] if alone else [t for t in times if now - at[t] <= keep]
        times.append(k)
        if not alone and code[k - 1] >= 0 and code[k - 1] != code[k]:
            found.append((k, len(times)))
        last = now if last is None else max(last, now)
    return found, times


def _changed(batches: Iterator[pd.DataFrame], state: GroupState, keep: int) -> Iterator[pd.DataFrame]:
    """The entries of a shard's stories over their updates (story_, at_: microseconds, status), by arrays.

    State: the updates of each story within so many microseconds of its last, in their order; the last one has its status.
    What is older than that counts for nothing, so when it goes changes no entry."""
    mark = state.getCurrentWatermarkMs()
    story, at, code, names = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
    if state.exists:
        blob, names = state.get
        story, at, code = np.frombuffer(blob, np.int64).reshape(3, -1)
        names = list(names)
    fresh = np.zeros(len(story), bool)
    if not state.hasTimedOut:
        told = pd.concat(list(batches))
        status = told["status"].astype(object).where(told["status"].notna(), None)
        every = sorted(set(names) | {x for x in status.unique() if x is not None})
        place = {x: k for k, x in enumerate(every)}
        code = np.array([place[x] for x in names] + [-1], np.int64)[code]
        names, new = every, status.map(place).fillna(len(every)).to_numpy(np.int64)
        order = np.lexsort((new, told["at_"].to_numpy(), told["story_"].to_numpy()))
        new[new == len(every)] = -1
        parts = ((story, told["story_"].to_numpy()), (at, told["at_"].to_numpy()), (code, new), (fresh, np.ones(len(new), bool)))
        story, at, code, fresh = (np.concatenate([held, came[order]]) for held, came in parts)
        order = np.argsort(story, kind="stable")
        story, at, code, fresh = (x[order] for x in (story, at, code, fresh))
    first = np.r_[True, story[1:] != story[:-1]] if len(story) else np.zeros(0, bool)
    starts, rank = np.flatnonzero(first), np.cumsum(first) - 1
    ends = np.r_[starts[1:], len(story)] - 1 if len(starts) else starts
    gap = np.diff(at, prepend=at[:1])
    odd = np.zeros(len(starts), bool)
    odd[rank[~first & (gap < 0)]] = True
    span = int(at.max() - at.min()) + keep + 1 if len(at) else 1
    if len(starts) * span >= 1 << 62:
        odd[:] = True
    stays, low = np.zeros(len(story), bool), np.zeros(len(story), np.int64)
    if len(starts) and not odd.all():
        even = ~odd[rank]
        where = np.flatnonzero(even)
        line = rank[even] * span + (at[even] - at.min())
        low[where] = where[np.searchsorted(line, np.maximum(line - keep, rank[even] * span))]
        stays[where] = at[where] >= at[ends[rank[where]]] - keep
    changed = fresh & ~first & (gap <= keep) & ~odd[rank]
    changed[1:] &= (code[:-1] >= 0) & (code[:-1] != code[1:])
    at_place = np.flatnonzero(changed)
    recent = at_place - low[at_place] + 1
    more = []
    for k in np.flatnonzero(odd).tolist():
        s, e = starts[k], ends[k] + 1
        found, times = _one_by_one(at[s:e], code[s:e], fresh[s:e], keep)
        more += [(s + i, n) for i, n in found]
        stays[s + np.array(times, np.int64)] = True
    if more:
        at_place, recent = np.r_[at_place, [i for i, _ in more]], np.r_[recent, [n for _, n in more]]
    latest = np.maximum.reduceat(at, starts) if len(starts) else at
    stays &= (latest + keep >= mark * 1000)[rank]
    if stays.any():
        state.update((np.stack([story[stays], at[stays], code[stays]]).tobytes(), names))
        state.setTimeoutTimestamp(max(int(latest[rank[stays]].min() + keep) // 1000 + 1, mark + 1))
    else:
        state.remove()
    if len(at_place):
        named = np.array([*names, None], object)
        yield pd.DataFrame({"story": story[at_place], "micros": at[at_place], "before": named[code[at_place - 1]], "after": named[code[at_place]], "recent": recent.astype(np.int32)})


def status_changes(observed: DataFrame, hours: int = EngineConfig.match_hours) -> DataFrame:
    """STRM-7, RES-13: (story, at, before, after, recent): where a story's status changed, and its updates in so many hours
    up to then.  A story that was silent for longer begins anew, without an entry; its state goes by a timer of event
    time, so a replay of old data gives the same entries (Spark's own time to live counts processing time).

    observed: (story, at, status) with a watermark on at.  Start the query inside `rocksdb`."""
    keep = hours * 3_600_000_000
    rows = observed.select("at", "status", F.coalesce("story", F.lit(NO_STORY)).alias("story_"), F.unix_micros("at").alias("at_"))
    dealt = rows.withColumn("shard", F.pmod("story_", F.lit(SHARDS))).groupBy("shard")
    found = dealt.applyInPandasWithState(lambda _, b, s: _changed(b, s, keep), CHANGES, HELD, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.nullif("story", F.lit(NO_STORY)).alias("story"), F.timestamp_micros("micros").alias("at"), "before", "after", "recent")


STATE, STATUS = "events array<bigint>, starts array<bigint>, statuses array<string>", "event long, micros long, status string"


def _moved(batches: Iterator[pd.DataFrame], state: GroupState, hours: int, keep: int) -> Iterator[pd.DataFrame]:
    """The state of a shard's events over their announcements (event, start, at: microseconds), and what time makes
    of it with no new data.

    What comes due is told with the time at which it did, however late a batch or a timer brings it, so the
    entries don't depend on how the stream is cut."""
    hour, tick = 3_600_000_000, 1000
    end, keep = hours * hour, keep * hour
    held = {e: (start, last) for e, start, last in zip(*state.get, strict=True)} if state.exists else {}
    mark = state.getCurrentWatermarkMs()
    rows = []

    def due(event: int, start: int, last: str, until: int) -> str:
        if last == "UPCOMING" and until >= start:
            last = "LIVE"
            rows.append((event, start, last))
        if last == "LIVE" and until > start + end:
            last = "UNKNOWN"
            rows.append((event, start + end, last))
        return last

    if not state.hasTimedOut:
        told = pd.concat(list(batches)).sort_values("at_", kind="stable")
        for event, start, at in zip(told["event"].tolist(), told["start_"].tolist(), told["at_"].tolist(), strict=True):
            last = due(event, *held[event], at) if event in held else None
            status = "UPCOMING" if at < start else "LIVE" if at <= start + end else "UNKNOWN"
            if status != last:
                rows.append((event, at, status))
            held[event] = start, status
    left, wake = [], []
    for event, (start, last) in held.items():
        last, over = due(event, start, last, mark * 1000), start + end + keep
        if last != "UNKNOWN" or mark * 1000 <= over:  # else nothing more can come of it
            left.append((event, start, last))
            # the next time at which the status changes by itself, or at which the state may go
            wake.append({"UPCOMING": start, "LIVE": start + end + tick}.get(last, over + tick))
    if left:
        state.update(tuple(map(list, zip(*left, strict=True))))
        state.setTimeoutTimestamp(max(min(wake) // 1000, mark + 1))
    else:
        state.remove()
    if rows:
        yield pd.DataFrame(rows, columns=["event", "micros", "status"])


def lifecycle(announcements: DataFrame, hours: int = EngineConfig.event_hours, keep: int = EngineConfig.match_hours) -> DataFrame:
    """STRM-7, 8: status changes (event, at, status) of announced events (event, start, at with a watermark):
    keyed state, and a timer for what comes due when nothing more is said.  The state goes when so many
    hours have passed since the event must have ended; what is announced after that counts as a new event."""
    rows = announcements.select("event", "at", F.unix_micros("start").alias("start_"), F.unix_micros("at").alias("at_"), F.pmod("event", F.lit(SHARDS)).alias("shard"))
    moved = rows.groupBy("shard").applyInPandasWithState(lambda _, b, s: _moved(b, s, hours, keep), STATUS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return moved.select("event", F.timestamp_micros("micros").alias("at"), "status")
