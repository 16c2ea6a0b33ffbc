"""Landed feeds, posts and pages to the library's shapes (SRC-*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_title, excerpt, normalize, strip_html, truncate
from ..functions.timefn import parse_time

FEED_SCHEMA = "title string, link string, guid string, pubDate string, updated string, creator string, description string, media_url string, category array<string>, source string"
POSTS_SCHEMA = (
    "data array<struct<id:string,text:string,author_id:string,created_at:string,lang:string,public_metrics:struct<like_count:long,retweet_count:long,reply_count:long,quote_count:long,impression_count:long>,"
    "entities:struct<hashtags:array<struct<tag:string>>,mentions:array<struct<username:string>>>>>,includes struct<users:array<struct<id:string,username:string,name:string,verified:boolean>>>,meta struct<newest_id:string>"
)


def read_feed(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Items of landed RSS or Atom files."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(FEED_SCHEMA).load(path)


def feed_items(items: DataFrame) -> DataFrame:
    """SRC-1: items in the shape of articles; those without link or title drop."""
    text = strip_html(F.coalesce("description", F.lit("")))
    return items.select(
        clean_title(F.col("title")).alias("title"),
        F.coalesce("link", "guid").alias("url"),
        parse_time(F.coalesce("pubDate", "updated")).alias("published_at"),
        parse_time(F.col("updated")).alias("updated_at_source"),
        F.regexp_replace(F.trim("creator"), r"(?i)^by\s+", "").alias("author"),
        F.col("media_url").alias("image_url"),
        F.slice(F.coalesce("category", F.array().cast("array<string>")), 1, 12).alias("tags"),
        truncate(text, 1200).alias("content_snippet"),
        excerpt(text, 320).alias("excerpt"),
    ).filter(F.col("url").isNotNull() & (F.col("title") != ""))


def is_valid_item(url: Column, title: Column) -> Column:
    """SRC-2"""
    return url.startswith("http") & (F.length(F.trim(title)) >= 8)


def on_topic(title: Column, text: Column, words: list[str]) -> Column:
    """SRC-3: any of the words in the normalised title and text."""
    both = normalize(F.concat_ws(" ", title, text))
    return reduce(lambda a, b: a | b, (both.contains(w) for w in words), F.lit(False))


def attribute_publisher(items: DataFrame, classes: DataFrame) -> DataFrame:
    """SRC-4: aggregator items take their publisher's class; an unknown one is its own family at 0.3."""
    c = classes.select(F.col("normalized_id").alias("publisher_domain"), "classification", "reliability_weight", "independence_group")
    rows = items.join(c, "publisher_domain", "left")
    return rows.withColumns({"classification": F.coalesce("classification", F.lit("UNKNOWN")), "reliability_weight": F.coalesce("reliability_weight", F.lit(0.3)), "independence_group": F.coalesce("independence_group", "publisher_domain")})


def posts(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """SRC-5: API pages exploded into posts, with authors looked up in the same page."""
    page = payloads.select(F.from_json(column, POSTS_SCHEMA).alias("p"))
    users = F.map_from_entries(F.transform(F.coalesce("p.includes.users", F.array().cast("array<struct<id:string,username:string,name:string,verified:boolean>>")), lambda u: F.struct(u["id"], u)))
    rows = page.select(users.alias("users"), F.explode("p.data").alias("d"))
    m = "d.public_metrics."
    return rows.select(
        F.col("d.id").alias("post_id"),
        F.element_at("users", F.col("d.author_id"))["username"].alias("username"),
        "d.text",
        parse_time(F.col("d.created_at")).alias("created_at"),
        F.slice(F.transform("d.entities.hashtags", lambda h: h["tag"]), 1, 10).alias("hashtags"),
        F.slice(F.transform("d.entities.mentions", lambda h: h["username"]), 1, 10).alias("mentions"),
        F.col(f"{m}like_count").alias("like_count"),
        F.col(f"{m}retweet_count").alias("repost_count"),
        F.col(f"{m}reply_count").alias("reply_count"),
        F.col(f"{m}quote_count").alias("quote_count"),
        F.col(f"{m}impression_count").alias("impression_count"),
    )


def paragraphs(html: Column) -> Column:
    """Contents of the paragraphs outside navigation and scripts."""
    gone = "script|style|nav|header|footer|aside|form"
    body = F.regexp_replace(html, rf"(?is)<(?:{gone})\b.*?</(?:{gone})>", " ")
    return F.regexp_extract_all(body, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), 1)


def main_text(html: Column) -> Column:
    """SRC-6: the first twelve paragraphs of more than 60 characters."""
    long = F.filter(F.transform(paragraphs(html), strip_html), lambda p: F.length(p) > 60)
    return F.substring(F.array_join(F.slice(long, 1, 12), " "), 1, 1500)


def thin_articles(articles: DataFrame, as_of: Column, listed: list[str], most: int) -> DataFrame:
    """SRC-7: recent short articles of good sources, the newest."""
    recent = F.col("published_at") >= as_of - F.expr("INTERVAL 24 HOURS")
    rows = articles.filter(recent & (F.length("content_snippet") < 400) & (F.col("reliability_weight") >= 0.5) & ~F.col("domain").isin(*listed))
    return rows.orderBy(F.col("published_at").desc(), "url").limit(most)


def newest_ids(rows: DataFrame, key: str, post_id: str = "post_id") -> DataFrame:
    """SRC-8: the largest id per query; ids compare by length, then text."""
    return rows.groupBy(key).agg(F.max(F.struct(F.length(post_id), F.col(post_id)))[post_id].alias("newest_id"))
