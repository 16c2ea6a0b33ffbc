"""Articles, posts, events and bouts that Spark derives from the driver's orders, line items and events,
and the same in SQL.  Wording is chosen by key from the lists below; names come from two short lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import spread, table
from .shapes import pick

FIRST = ["Alex", "Bruno", "Carla", "Dmitri", "Élise", "Farid", "Gina"]
LAST = ["Adams", "Baker-Lee", "Costa", "Duarte", "Evans", "Fischer", "Gomez", "Hughes", "Ivanov", "Jones", "Kowalski"]
HEADLINES = [
    ("", " vs. ", " official for UFC 312 in Las Vegas - ESPN"), ("Report: ", " targeted for fight with ", " in the main event of UFC Fight Night"), ("", " defeats ", " by unanimous decision at UFC 299"),
    ("", " withdraws from fight with ", ", injury to blame | MMA Junkie"), ("", " steps in for ", " on short notice at UFC Vegas 88"), ("How to watch ", " vs ", ": start time, odds and preview"),
    ("Will ", " beat ", "? Expert picks and prediction"), ("", " denies talks with ", ", calls it a false report"), ("", " retires after loss to ", ", hangs up the gloves"),
    ("Rankings update: ", " passes ", " in the pound-for-pound top 15"), ("", " responds to ", " in exclusive interview - Sherdog.com"), ("Bout ", " vs. ", " called off over a failed drug test, per sources"),
    ("", " new champion, takes the title belt from ", " at Noche UFC"), ("Quiet day for ", " and ", " at the gym"),
]
BODIES = [
    "According to ESPN, the two sides agreed. The bout is on the main card &amp; <b>more</b> will follow.",
    "Per Ariel Helwani, sources say the lightweight title fight is expected in October 2026.",
    'The fighter told MMA Fighting: "We will be ready for this one" today. A torn ligament needs surgery and weeks of rest.',
    "UFC officials confirmed the news on Saturday. It was made official by the promotion.",
    "No details were given. A statement will follow.",
    "A suspension could follow. First reported by BBC and later via Sports Illustrated.",
    "Results and highlights: the winner knocked out the champion. What comes next is unclear.",
]
SOURCES = ["MMA Fighting", "ESPN", "UFC", "Fan Blog", "Ariel Helwani", "Somebody"]
KINDS = ["MAJOR_NEWS", "major news", "OFFICIAL", "Fan account", "Trusted Journalist", ""]
NOW = "1998-09-01 12:00:00"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


def chosen(index: str, values: list[str]) -> str:
    return f"({listed(values)})[({index}) % {len(values)} + 1]"


def person(index: Column) -> Column:
    return F.concat(pick(index, FIRST), F.lit(" "), pick(index, LAST))


def person_sql(index: str) -> str:
    return f"{chosen(index, FIRST)} || ' ' || {chosen(index, LAST)}"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, at, a, b, title, body, source_name, source_type, url: an article for every order."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), F.col("o_orderdate").cast("timestamp").alias("day"))
    named = spread(o).select("*", person(F.col("c")).alias("a"), person(F.col("c") * 3 + F.col("id")).alias("b"))
    pre, mid, post = (pick(F.col("id"), [h[k] for h in HEADLINES]) for k in range(3))
    return named.select(
        "id",
        (F.col("day") + F.make_dt_interval(hours=(F.col("id") % 24).cast("int"))).alias("at"),
        "a",
        "b",
        F.concat(pre, "a", mid, "b", post).alias("title"),
        pick(F.floor(F.col("id") / len(HEADLINES)), BODIES).alias("body"),
        pick(F.col("c"), SOURCES).alias("source_name"),
        pick(F.col("c"), KINDS).alias("source_type"),
        F.concat(F.lit("http://www.example.com//news/"), (F.col("id") % 500).cast("string"), F.lit("/?utm_source=x&b=2&a="), F.col("c").cast("string")).alias("url"),
    )


ARTICLES = f"""art AS (SELECT id, day + to_hours(id % 24) AS t0, a, b, {chosen('id', [h[0] for h in HEADLINES])} || a || {chosen('id', [h[1] for h in HEADLINES])} || b || {chosen('id', [h[2] for h in HEADLINES])} AS title,
  {chosen(f'id // {len(HEADLINES)}', BODIES)} AS body, {chosen('c', SOURCES)} AS source_name, {chosen('c', KINDS)} AS source_type, 'http://www.example.com//news/' || (id % 500) || '/?utm_source=x&b=2&a=' || c AS url
  FROM (SELECT o_orderkey AS id, o_custkey AS c, o_orderdate AS day, {person_sql('o_custkey')} AS a, {person_sql('o_custkey * 3 + o_orderkey')} AS b FROM orders))"""


CUSTOMER_SQL = "CAST(regexp_extract(url, '([0-9]+)$', 1) AS BIGINT)"


def known(spark: SparkSession) -> DataFrame:
    """The first eleven people: every last name once."""
    return spark.range(len(LAST)).select(F.col("id").alias("entity"), person(F.col("id")).alias("name"), F.array().cast("array<string>").alias("aliases"))
