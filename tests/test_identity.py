"""Names, merges and corrections on rows made by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from evidentia.operators import cards, entities, identity, resolve
from evidentia.sources.scratch import keep


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Crypto.com UFC 331", "UFC 331"), ("crypto . com UFC 331", "UFC 331"), ("CRYPTO COM UFC 331", "UFC 331"), ("Dana White's Contender Series 45", "45"), ("Dana  Whites Contender Series", ""),
        ("DANA WHITE CONTENDER SERIES: Week 2", "Week 2"), ("Riyadh  Season UFC 5 - Presented by Acme", "UFC 5"), ("presented by", ""), ("", ""), ("UFC Monster Energy 9", "UFC 9"),
    ],
)
def test_sponsors(spark, given, want):
    assert one(spark, resolve.strip_sponsors(F.lit(given))) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Jones vs. Aspinall set", ["aspinall|jones"]), ("A Big Card: Ann Bell versus Cy Dunn", ["ann bell|cy dunn"]), ("Ann Bell vs Cy Dunn vs Ed Fox", ["ann bell|cy dunn"]),
        ("Ann Bell vs Cy Dunn. Later Ed Fox vs Gus Hill", ["ann bell|cy dunn later ed", "fox|gus hill"]), ("One Two Three Four Five Six vs Seven", ["seven|three four five six"]), ("he vs she", []), ("vs Ann", []), ("", []),
        ("Ann vs Bob, Cyd vs Dan, Eve vs Fay, Gil vs Hal, Ida vs Jon", ["ann|bob", "cyd|dan", "eve|fay", "gil|hal"]), ("Bob vs Ann; Ann vs Bob", ["ann|bob"]),
    ],
)
def test_matchups(spark, given, want):
    assert one(spark, entities.find_matchups(F.lit(given))) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [("Rankings as of May 4, 2026", dt.date(2026, 5, 4)), ("Updated: 2026-05-04", dt.date(2026, 5, 4)), ("rankings for June 11, 2025 and more", dt.date(2025, 6, 11)), ("as of Smarch 4, 2026", None), ("May 4, 2026", None), ("", None)],
)
def test_ranking_dates(spark, given, want):
    assert one(spark, cards.ranking_date(F.lit(given))) == want


EVENT = "event long, key string, name string, data_origin string, merged_into long, venue string, mentions long, last_seen long"


def test_merge_keeps_what_is_the_keepers(spark):
    events = [
        (1, "k", "UFC Fight Night", "detected", None, "a", 1, 5), (2, "k", "UFC Fight Night: Silva vs Costa", "detected", None, None, 2, 9), (3, "k", "Night", "collected", None, None, 4, 7),
        (4, "q", "Other", "user", None, "b", 1, 1), (5, "k", "Old", "official", 2, "z", 50, 99), (6, "r", "Older", "user", 5, None, 0, 0),
    ]
    bouts = [(10, 3, "x|y", "own"), (11, 2, "x|y", "lost"), (12, 1, "u|v", "second"), (13, 2, "u|v", "first"), (14, 4, "x|y", "other")]
    aliases = [("night", 3), ("night", 1), ("fight", 2), ("fight", 1), ("other", 4)]
    found = identity.merge_events(spark.createDataFrame(events, EVENT), spark.createDataFrame(bouts, "id long, event long, pair_key string, status string"), spark.createDataFrame(aliases, "alias_key string, event long"), keep, ["venue"], ["mentions"], ["last_seen"])
    rows = {r.event: r for r in found["events"].collect()}
    assert set(rows) == {3, 4} and (rows[3].name, rows[3].venue, rows[3].mentions, rows[3].last_seen, rows[3].merged) == ("Night", "a", 7, 9, 2)
    # of two losers the better named one comes first
    assert {(r.event, r.pair_key, r.status) for r in found["bouts"].collect()} == {(3, "x|y", "own"), (3, "u|v", "first"), (4, "x|y", "other")}
    assert {(r.alias_key, r.event) for r in found["aliases"].collect()} == {("night", 3), ("fight", 3), ("other", 4)}
    assert {(r.id, r.target) for r in found["redirects"].collect()} == {(1, 3), (2, 3), (5, 3), (6, 3)}
    # run again on its own result, nothing is left to merge
    again = found["events"].withColumn("merged_into", F.lit(None).cast("long"))
    assert identity.merge_mapping(again).isEmpty()
    keys = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "id long, keys array<string>")
    known = spark.createDataFrame([("a", 5), ("b", 3)], "alias_key string, event long").withColumn("event", F.col("event").cast("string"))
    dead = spark.createDataFrame([("5",)], "event string")
    assert {r.id: r.event for r in resolve.resolve_identity(keys, identity.live_aliases(known, dead)).collect() if not r.is_new} == {1: "3"}


def test_bad_corrections_change_nothing(spark):
    day = lambda k: dt.datetime(2024, 5, k)
    stories = spark.createDataFrame([(1, 7, "general"), (2, None, "injury")], "story long, event long, category string")
    sources = spark.createDataFrame([(1, "UNKNOWN", 0.3)], "source long, source_type string, reliability double")
    links = spark.createDataFrame([(1, 100), (1, 101), (2, 100)], "story long, article long")
    made = [
        (1, "recategorise", 1, "injury", None, "a", day(1)), (2, "recategorise", 1, "title", None, "b", day(2)), (3, "recategorise", 1, "gossip", None, "c", day(3)), (4, "recategorise", 9, "title", None, "d", day(3)),
        (5, "reassign_event", 1, "8", None, "e", day(1)), (6, "reassign_event", 1, "99", None, "f", day(2)), (7, "reassign_event", 2, " 8 ", None, "g", day(1)), (8, "reassign_event", 2, None, None, "h", day(2)),
        (9, "reclassify", 1, "fan account", 7.5, "i", day(1)), (10, "reclassify", 1, "Official", None, "j", day(2)), (11, "detach", 1, "100", None, "k", day(1)), (12, "detach", 1, "100", None, "l", day(2)),
        (13, "detach", 2, "101", None, "m", day(1)), (14, "erase", 1, None, None, "n", day(1)), (15, None, 1, None, None, "o", day(1)), (16, "reassign_event", 1, "x", None, "p", day(4)),
    ]
    corrections = spark.createDataFrame(made, "id long, kind string, target long, value string, weight double, reason string, at timestamp").repartition(3)
    events = spark.createDataFrame([(7,), (8,)], "event long")
    found = identity.apply_corrections(stories, sources, links, corrections, events, ["general", "injury", "title"])
    assert {tuple(r) for r in found["stories"].collect()} == {(1, 8, "title"), (2, None, "injury")}
    assert [tuple(r) for r in found["sources"].collect()] == [(1, "OFFICIAL", 1.0)]
    assert {tuple(r) for r in found["links"].collect()} == {(1, 101), (2, 100)}
    audit = {r.id: (r.before, r.after) for r in found["audit"].collect()}
    assert audit == {1: ("general", "injury"), 2: ("injury", "title"), 5: ("7", "8"), 7: (None, "8"), 8: ("8", None), 9: ("UNKNOWN|0.3", "FAN_ACCOUNT|1.0"), 10: ("FAN_ACCOUNT|1.0", "OFFICIAL|1.0"), 11: ("100", None)}
    wrong = {r.id: r.error for r in found["rejected"].collect()}
    assert wrong == {3: "no such category", 4: "no such target", 6: "no such event", 12: "no such link", 13: "no such link", 14: "no such kind", 15: "no such kind", 16: "no such event"}
    # without corrections all stays, and all tables may be empty
    for rows in (corrections.limit(0), corrections.filter("id = 3")):
        same = identity.apply_corrections(stories, sources, links, rows, events, ["general"])
        assert same["audit"].isEmpty() and sorted(map(str, same["stories"].collect())) == sorted(map(str, stories.collect())) and same["links"].count() == 3
    nothing = identity.apply_corrections(stories.limit(0), sources.limit(0), links.limit(0), corrections, events.limit(0), [])
    assert nothing["stories"].isEmpty() and nothing["rejected"].count() == len(made)


def test_corrections_of_one_time_and_id_have_an_order(spark):
    """What (at, id) leaves open is settled by the values, not by how rows arrive."""
    stories = spark.createDataFrame([(1, 7, "general")], "story long, event long, category string")
    sources = spark.createDataFrame([(1, "UNKNOWN", 0.3)], "source long, source_type string, reliability double")
    links, events = spark.createDataFrame([(1, 100)], "story long, article long"), spark.createDataFrame([(7,)], "event long")
    made = [(1, "recategorise", 1, v, None, "a", dt.datetime(2024, 5, 1)) for v in ("title", "injury", "general", "ranking")]
    schema = "id long, kind string, target long, value string, weight double, reason string, at timestamp"
    told = set()
    for rows in (made, made[::-1], made[2:] + made[:2]):
        found = identity.apply_corrections(stories, sources, links, spark.createDataFrame(rows, schema).coalesce(1), events, ["general", "injury", "title", "ranking"])
        told.add((found["stories"].first()["category"], tuple(sorted((r["before"], r["after"]) for r in found["audit"].collect()))))
    assert told == {("title", (("general", "general"), ("general", "injury"), ("injury", "ranking"), ("ranking", "title")))}
