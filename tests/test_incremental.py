"""Stories that are refreshed, streams of many batches, and copies that are folded before pairs are made."""

import datetime as dt
import os
import random
import re
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidentia import plans
from evidentia.config import EngineConfig
from evidentia.operators import cards, evidence, matching, rebuild
from evidentia.plans import stream_queries
from evidentia.sources.scratch import keep, new_folder
from evidentia.streaming import runlog, sinks, state

from test_queries import rows_of

START = dt.datetime(2024, 5, 1, 12)
ITEM = "story long, kind string, at timestamp, family string, name string, source_type string, weight double, derivative boolean, official_words boolean, denial boolean, speculation double, category string, engagement long, excerpt string"


def item(rng, story, at):
    kind = rng.choice(["OFFICIAL", "MAJOR_NEWS", "TRUSTED_REPORTER", "UNKNOWN", "FIGHTER"])
    return (
        story, rng.choice(["news", "news", "social"]), at, rng.choice("abcdef"), f"n{rng.randint(0, 9)}", kind, 0.5, rng.random() < 0.2, rng.random() < 0.2, rng.random() < 0.1,
        rng.choice([0.0, 0.5, 1.0]), rng.choice(["injury", "general", "rumor", "title"]), rng.choice([None, 100, 60_000]), rng.choice([None, "", "said so"]),
    )


def at(hours):
    return F.lit(START + dt.timedelta(hours=hours)).cast("timestamp")


def shown(df):
    return sorted((tuple(sorted(v.items()) if isinstance(v, dict) else v for v in r) for r in df.collect()), key=str)


def test_refresh_equals_a_full_rebuild(spark):
    """Items come, change and go, and the clock moves on, also where nothing else does."""
    rng, path = random.Random(11), new_folder(spark)
    items = [item(rng, s, START - dt.timedelta(hours=rng.choice([0, 1, 5, 12, 40, 90, 200]), seconds=rng.randint(0, 3))) for s in range(60) for _ in range(rng.randint(1, 4))]
    config = EngineConfig(breaking_relevance=20.0)
    for hours, edit in ((0, None), (0, "same"), (1, None), (3, "change"), (3.5, None), (9, "come"), (12, None), (13, "go"), (60, None), (100, "come back")):
        if edit == "change":
            items[3:6] = [item(rng, r[0], r[2]) for r in items[3:6]]
        if edit in ("come", "come back"):
            items += [item(rng, s, START + dt.timedelta(hours=hours - 1)) for s in (2, 7, 61, 62)]
        if edit == "go":
            items = [r for r in items if r[0] not in (7, 8, 62)]
        table = spark.createDataFrame(items, ITEM).repartition(3)
        done = rebuild.refresh(table, path, at(hours), config, buckets=8).collect()
        full = evidence.rebuild_stories(table, at(hours), config)
        found = rebuild.read_stories(spark, path)
        assert shown(found.select(*full.columns)) == shown(full)
        if edit == "same":
            assert not done
        if edit == "change":
            assert {r.story for r in done if r.reason == "changed"} == {r[0] for r in items[3:6]}
        if edit == "go":
            assert {r.story for r in done if r.reason == "gone"} == {7, 8, 62}
        if edit == "come back":
            assert {r.story for r in done if r.reason == "new"} == {7, 62}
        if hours == 9:
            assert len(done) < 60


def test_a_refresh_leaves_other_parts_alone(spark):
    """One story's change rewrites one part of the table, and rebuilds one story."""
    rng, path = random.Random(5), new_folder(spark)
    old = START - dt.timedelta(days=30)
    items = [item(rng, s, old) for s in range(300)]
    rebuild.refresh(spark.createDataFrame(items, ITEM), path, at(0))
    files = lambda: {(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    before, seen = files(), []
    items[17] = (*items[17][:10], 0.25, *items[17][11:])

    def counted(rows, as_of, config):
        seen.extend(r.story for r in rows.select("story").distinct().collect())
        return evidence.rebuild_stories(rows, as_of, config)

    done = rebuild.refresh(spark.createDataFrame(items, ITEM), path, at(1), rebuild=counted).collect()
    assert [(r.story, r.reason) for r in done] == [(17, "changed")] and seen == [17]
    assert len({d for d, _ in before - files()}) == 1
    assert rebuild.read_stories(spark, path).count() == 300


def test_prints_see_what_moves(spark):
    rows = [(1, "a", None), (2, None, "a"), (3, "a", "a"), (4, "b", "b")]
    one = lambda r: spark.createDataFrame(r, "k long, x string, y string").groupBy().agg(rebuild.set_hash(rebuild.row_hash(["x", "y"])).alias("h")).first().h
    assert len({one([r]) for r in rows}) == 4
    # pairs of equal rows cancel each other in an exclusive or
    assert one([rows[2], rows[2]]) != one([rows[3], rows[3]])
    assert one(rows) == one(rows[::-1])


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    return con


@pytest.mark.parametrize("name", ["strm_trend", "strm_bursts", "strm_touched", "strm_status_changes", "strm_lifecycle", "strm_ingest"])
def test_streams_of_ten_batches(spark, sf_dir, duck, monkeypatch, name):
    """One run that reads ten files, one a batch, instead of a run for each part."""
    whole = stream_queries.in_runs
    monkeypatch.setattr(stream_queries, "in_runs", lambda spark, sf_dir, sink, *a, **k: whole(spark, sf_dir, sink, 10, batches=True))
    assert rows_of(plans.QUERIES[name](spark, sf_dir).toPandas()) == rows_of(duck.execute(plans.SQL[name]).df())


def test_late_rows_go_to_their_own_table(spark, sf_dir, monkeypatch):
    whole, seen = stream_queries.in_runs, {}

    def sink_of(sink):
        def run(rows, out):
            seen["tables"] = sink(rows, out)
            return seen["tables"]

        return run

    monkeypatch.setattr(stream_queries, "in_runs", lambda spark, sf_dir, sink, *a, **k: whole(spark, sf_dir, sink_of(sink), 10, part=F.col("event_id") % 10, batches=True))
    found = plans.QUERIES["strm_late"](spark, sf_dir)
    kept, late = seen["tables"]
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert kept.count() + late.count() == n == found.select("event_id").distinct().count() and late.count() > 0


def test_a_repeated_batch_changes_nothing(spark):
    path = new_folder(spark)
    batch = lambda rows: spark.createDataFrame(rows, "k long, v string")
    sinks.merge_batch(batch([(1, "a"), (2, "b"), (None, "n")]), path, ["k"])
    for _ in range(2):
        sinks.merge_batch(batch([(2, "c"), (2, "d"), (3, "e"), (None, "m")]), path, ["k"])
        sinks.merge_batch(batch([]), path, ["k"])
        assert sorted((r.k or 0, r.v) for r in spark.read.parquet(path).collect()) == [(0, "m"), (1, "a"), (2, "d"), (3, "e")]


def test_a_hundred_and_fifty_batches_are_counted(spark, sf_dir):
    """Spark itself keeps the progress of a hundred."""
    path, folder, out = new_folder(spark), new_folder(spark), new_folder(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    events.withColumn("part", F.col("event_id") % 150).repartition(8, "part").write.partitionBy("part").parquet(folder)
    with runlog.RunLog(spark, path) as log:
        rows = spark.readStream.schema("event_id long, event_type string, part long").option("maxFilesPerTrigger", 1).parquet(folder)
        counted = rows.observe("run", F.count(F.lit(1)).alias("rows"), F.count_if(F.col("event_type") != "error").alias("ok"), F.count_if(F.col("event_type") == "error").alias("failed"))
        log.wait(counted.writeStream.format("noop").option("checkpointLocation", out).trigger(availableNow=True).start())
    runs = runlog.read_runs(spark, path)
    assert runs.filter("rows > 0").count() >= 150
    total = runs.agg(F.sum("rows"), F.sum("ok"), F.sum("failed")).first()
    bad = events.filter("event_type = 'error'").count()
    assert tuple(total) == (events.count(), events.count() - bad, bad)
    # the log read twice, as after a failure
    spark.read.parquet(path).limit(20).coalesce(1).write.mode("append").parquet(path)
    assert tuple(runlog.read_runs(spark, path).agg(F.sum("rows"), F.sum("ok"), F.sum("failed")).first()) == tuple(total)
    (fresh,) = runlog.freshness(runs.withColumn("at", at(0)), at(72)).collect()
    assert fresh.freshness == "stale" and fresh.last_success == START and fresh.outcome == ("PARTIAL" if bad else "SUCCESS")


@pytest.mark.parametrize("kind", ["status", "lifecycle"])
def test_state_ends(spark, kind):
    """Days of other stories each: what the state holds follows from three days, not from the stream's length."""
    folder, out = new_folder(spark), new_folder(spark)
    held = []
    for day in range(16):
        rows = [(day * 100 + k, START + dt.timedelta(days=day, minutes=k), s) for k in range(20) for s in ("REPORTED", "CONFIRMED")]
        spark.createDataFrame(rows, "story long, at timestamp, status string").coalesce(1).write.mode("append").parquet(folder)
        told = spark.readStream.schema("story long, at timestamp, status string").parquet(folder)
        if kind == "status":
            stream = state.status_changes(told.withWatermark("at", "1 hour"))
        else:
            stream = state.lifecycle(told.select(F.col("story").alias("event"), (F.col("at") + F.make_dt_interval(hours=F.lit(2))).alias("start"), "at").withWatermark("at", "1 hour"))
        with state.rocksdb(spark):
            running = stream.writeStream.format("noop").outputMode("append").option("checkpointLocation", out).trigger(availableNow=True).start()
        running.awaitTermination()
        held.append(running.lastProgress.stateOperators[0].numRowsTotal)
    assert max(held[8:]) <= max(held[:8]) and held[-1] > 0
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")


def test_lifecycle_calls_are_shared(spark):
    """Tens of thousands of events, each announced once, in two runs: a call for each event and timer would take minutes."""
    began, folder, out = time.perf_counter(), new_folder(spark), new_folder(spark)
    base = int(START.replace(tzinfo=dt.timezone.utc).timestamp())
    for run in range(2):
        at = F.timestamp_seconds(F.lit(base + run * 86_400) + F.col("id") % 3600)
        made = spark.range(30_000).select((F.col("id") + run * 30_000).alias("event"), (at + F.make_dt_interval(hours=F.lit(2))).alias("start"), at.alias("at"))
        made.write.mode("append").parquet(folder)
        told = spark.readStream.schema(made.schema).parquet(folder).withWatermark("at", "1 hour")
        found = sinks.appended(state.lifecycle(told), out)
    counts = {(r.first_run, r.status): r["count"] for r in found.groupBy((F.col("event") < 30_000).alias("first_run"), "status").count().collect()}
    assert counts == {(True, "UPCOMING"): 30_000, (True, "LIVE"): 30_000, (True, "UNKNOWN"): 30_000, (False, "UPCOMING"): 30_000}
    assert time.perf_counter() - began < 60


ARTICLE = "id long, at timestamp, title string, text string, entities array<string>, events array<string>, category string, has_denial boolean, url string"


def news(rng, n, distinct, hours, fixed=None):
    heads = ["Costa signs for title fight in Rio", "Costa signs for a title fight in Rio de Janeiro", "Baker out with injury", "Baker out of main event with knee injury", "", "Quiet week", "Costa denies title fight in Rio", "the of and"]
    bodies = ["the bout was announced by the promotion on monday in rio", "the bout was announced by the promotion on monday in rio with fans", "a knee injury keeps baker out of the card", "", "nothing happened this week at the gym"]
    made = [(rng.choice(heads), rng.choice(bodies), rng.choice([[], ["costa"], ["baker"], ["costa", "baker"]]), rng.choice([[], ["ufc 1"]]), rng.choice(["injury", "result", "general"]), rng.random() < 0.2) for _ in range(distinct)]
    for k in range(n):
        yield (k, START + dt.timedelta(hours=rng.randint(0, hours), minutes=rng.choice([0, 0, 7])), *(fixed or rng.choice(made)), f"http://a.org/{rng.randint(0, n // 3)}")


@pytest.mark.parametrize(("seed", "hours"), [(1, 30), (2, 300), (3, 1500), (4, 80)])
def test_folded_clusters_equal_pairwise_ones(spark, seed, hours):
    """Many copies, at one time and at many: the same parents as from all pairs."""
    rows = spark.createDataFrame(list(news(random.Random(seed), 150, 25, hours)), ARTICLE).repartition(3)
    weights = keep(matching.tfidf(rows.select("id", "text")))
    scored = keep(matching.score_pairs(matching.cosine(matching.candidate_pairs(rows, weights), weights), rows))
    pairwise = {r.id: (r.story, r.role, round(r.similarity, 9)) for r in matching.cluster(rows, scored, keep).collect()}
    folded = {r.id: (r.story, r.role, round(r.similarity, 9)) for r in matching.cluster_articles(rows, keep).collect()}
    assert folded == pairwise


def test_copies_of_one_headline_make_no_pairs(spark):
    """A hundred thousand copies within a week cost what they hold."""
    fixed = ("Costa signs for title fight in Rio", "the bout was announced by the promotion on monday", ["costa"], ["ufc 1"], "general", False)
    rows = keep(spark.createDataFrame(list(news(random.Random(6), 100_000, 1, 160, fixed)), ARTICLE).repartition(8))
    members, sizes = matching.fold_equal(rows, F.to_json(F.struct("text", *matching.FEATURES)))
    assert members.count() == 100_000 and sizes.count() == 1
    began = time.perf_counter()
    stories = matching.cluster_articles(rows, keep).groupBy("story").count().collect()
    assert len(stories) == 1 and stories[0]["count"] == 100_000
    found = matching.duplicate_report(rows, keep)
    counts = {(r.reason, r.relation): r["count"] for r in found.groupBy("reason", "relation").count().collect()}
    assert counts[("headline", "copy")] == counts[("text", "copy")] == 99_999 and not any(relation == "near" for _, relation in counts)
    assert time.perf_counter() - began < 240


def test_report_loses_no_link(spark):
    """Pairs of representatives and copies together give every pair of the brute-force report."""
    rows = list(news(random.Random(8), 90, 15, 500))
    found = matching.duplicate_report(spark.createDataFrame(rows, ARTICLE).repartition(3), keep).collect()
    rep = {k: {r[0]: r[0] for r in rows} for k in ("same URL", "headline", "text")}
    for r in found:
        if r.relation == "copy":
            rep[r.reason][r.a] = r.b
    links = {(r.reason, r.a, r.b) for r in found if r.relation == "near"}
    joined = lambda why, a, b: (x := rep[why][a]) == (y := rep[why][b]) or (why, min(x, y), max(x, y)) in links
    from evidentia.functions.text import normalize_title, token_set

    heads = {r.id: set(r.t) for r in spark.createDataFrame(rows, ARTICLE).select("id", token_set(normalize_title(F.col("title"))).alias("t")).collect()}
    for k, a in enumerate(rows):
        for b in rows[:k]:
            x, y = heads[a[0]], heads[b[0]]
            assert joined("headline", a[0], b[0]) == bool(x and y and len(x & y) / min(len(x), len(y)) >= 0.8)
            assert joined("same URL", a[0], b[0]) == (a[-1] == b[-1])


def test_posts_meet_the_stories_of_their_days(spark):
    post = "post long, at timestamp, text string, entities array<string>, events array<string>"
    story = "story long, last_seen timestamp, headline string, entities array<string>, events array<string>"
    when = lambda h: START + dt.timedelta(hours=h)
    same = ("Costa signs for title fight", ["Costa"], [])
    posts = spark.createDataFrame([(1, when(0), *same), (2, when(72), *same), (3, when(73), *same), (4, when(-48), *same), (5, when(-49), *same)], post)
    stories = spark.createDataFrame([(1, when(0), *same)], story)
    assert {r.post for r in matching.link_posts(posts, stories).collect()} == {1, 2, 4}
    # one name in everything, over years: a post meets what happens in its days
    many = spark.range(100, 20_100).select(F.col("id").alias("n"), (F.lit(START).cast("timestamp") + F.make_dt_interval(hours=(F.col("id") * 3).cast("int"))).alias("t"))
    text, names, none = F.concat(F.lit("Costa item "), F.col("n").cast("string")), F.array(F.lit("Costa")), F.array().cast("array<string>")
    began = time.perf_counter()
    found = matching.link_posts(many.select(F.col("n").alias("post"), F.col("t").alias("at"), text.alias("text"), names.alias("entities"), none.alias("events")), many.select(F.col("n").alias("story"), F.col("t").alias("last_seen"), text.alias("headline"), names.alias("entities"), none.alias("events")))
    assert found.filter("post = story").count() == 20_000 and time.perf_counter() - began < 120


ITEM = "story long, kind string, at timestamp, family string, name string, source_type string, weight double, derivative boolean, official_words boolean, denial boolean, speculation double, category string, engagement long"


def test_stories_are_told_from_items_as_they_are(spark):
    """No distinct count multiplies the items, and what is shuffled is sent by story alone."""
    rows = [(1, kind, START, family, "n", "MAJOR_NEWS", 0.8, copied, False, False, 0.0, "injury", None) for kind in ("news", "social") for family in ("a", "b", None) for copied in (False, True)]
    found = evidence.rebuild_stories(spark.createDataFrame(rows, ITEM), at(0))
    planned = found._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in planned
    assert len(re.findall(r"hashpartitioning\(story#\d+L?, \d+\)", planned)) == planned.count("hashpartitioning(") <= 3
    (story,) = found.collect()
    # a family counts once, a missing one not at all, and copies are never independent
    assert (story.source_count, story.independent_count, story.credible_accounts, story.social_count) == (2, 2, 2, 6)
    assert (story.copied_families, story.better_sources, story.evidence_rows, story.recent_families) == (3, 12, 12, 2)


def test_orders_of_a_feed_share_what_it_shows(spark, sf_dir):
    """five orders read the feed's rows, not the line items five times."""
    assert not any("lineitem" in f for f in plans.QUERIES["win_feed_sorts"](spark, sf_dir).inputFiles())


def test_windows_are_made_from_hours(spark, sf_dir, monkeypatch):
    """what the stream keeps and merges is a row for each story, hour and family, not one for each window."""
    seen, merged = [], sinks.merged
    monkeypatch.setattr(sinks, "merged", lambda *a, **k: seen.append(merged(*a, **k)) or seen[-1])
    found = plans.QUERIES["strm_trend"](spark, sf_dir)
    assert seen[-1].count() <= spark.read.parquet(f"{sf_dir}/events.parquet").count() < found.count()


def test_texts_are_worked_out_once(spark, sf_dir):
    """a text is normalised once, whatever it is held against."""
    assert not any("documents" in f for f in plans.QUERIES["str_set_similarity"](spark, sf_dir).inputFiles())
    rows = spark.createDataFrame([(1, "Bruno Adams replaces Carla Costa", "an injury", "injury", ["Carla Costa"])], "id long, title string, body string, category string, entities array<string>").repartition(1)
    found = cards.detect_changes(rows)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("concat_ws(. ") == 1
    assert [(r.change_type, r.before_text, r.after_text, r.reason) for r in found.collect()] == [("replacement", "Carla Costa", "Bruno Adams", "injury")]


def test_corrections_of_one_event_are_dealt(spark, sf_dir):
    """corrections that name one event, or none, are not one key of a join."""
    planned = plans.QUERIES["res_rejected_corrections"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in planned.split("\n") if "Join LeftOuter" in line and "value#" in line and "target#" not in line]
    assert joins and all("place#" in line for line in joins)


class Held:
    """A group's state in memory."""

    def __init__(self):
        self.get, self.exists, self.hasTimedOut, self.mark, self.wake = None, False, False, 0, None

    def getCurrentWatermarkMs(self):  # noqa: N802
        return self.mark

    def update(self, value):
        self.get, self.exists = value, True

    def setTimeoutTimestamp(self, at):  # noqa: N802
        self.wake = at

    def remove(self):
        self.get, self.exists = None, False


@pytest.mark.parametrize("disorder", [0, 40])
def test_status_changes_of_many_stories_in_one_call(disorder):
    """Many stories share a call and a state, in any cut and somewhat out of order: the entries that each has by itself."""
    hour, keep, rng = 3_600_000_000, 6 * 3_600_000_000, random.Random(9)
    rows = sorted((k * hour // 40 + rng.randint(0, hour), rng.randint(0, 30), rng.choice(["A", "B", None, "C"])) for k in range(3000))
    cuts = [rows[i : i + 500] for i in range(0, 3000, 500)]
    for a, b in zip(cuts, cuts[1:], strict=False):  # the last of a batch come with the next
        b[:0], a[len(a) - disorder :] = a[len(a) - disorder :], []
        rng.shuffle(b)
    want, told = [], {}
    got, held = [], Held()
    for part in cuts:
        for at, story, status in sorted(part, key=lambda r: (r[0], r[2] is None, r[2] or "")):
            last, before, times = told.get(story, (None, None, []))
            if last is not None and at - last > keep:
                before, times = None, []
            times = [t for t in times if at - t <= keep] + [at]
            if before is not None and before != status:
                want.append((story, at, before, status, len(times)))
            told[story] = (at if last is None else max(at, last), status, times)
        frame = pd.DataFrame({"story_": [r[1] for r in part], "at_": [r[0] for r in part], "status": [r[2] for r in part]})
        for found in state._changed(iter([frame]), held, keep):
            got += [(*r[:3], r[3], r[4]) for r in found.itertuples(index=False, name=None)]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 500
    held.hasTimedOut, held.mark = True, rows[-1][0] // 1000 + keep // 1000 + 2
    assert list(state._changed(iter([]), held, keep)) == [] and not held.exists
