"""Text expressions (STR-*): Column to Column, all inside whole-stage codegen or higher-order functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicons import PUBLISHERS, STOPWORDS


def _accents() -> tuple[str, str]:
    """Latin letters with marks and what is left without the marks, by Unicode decomposition."""
    pairs = [(chr(cp), unicodedata.normalize("NFKD", chr(cp))) for cp in range(0xC0, 0x250)]
    pairs = [(c, "".join(x for x in d if not unicodedata.combining(x))) for c, d in pairs]
    pairs = [(c, d) for c, d in pairs if len(d) == 1 and d != c]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


ACCENTED, PLAIN = _accents()
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&hellip;": "…", "&ndash;": "–", "&mdash;": "—", "&amp;": "&"}


def let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.transform(F.array(value), then)[0]


def collapse(c: Column) -> Column:
    """STR-2"""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_html(c: Column) -> Column:
    """STR-1: tags to spaces, named entities decoded (the ampersand last), white space collapsed."""
    # most texts have neither, and a look is cheaper than so many replacements
    bare = F.when(c.contains("<"), F.regexp_replace(c, "<[^>]+>", " ")).otherwise(c)
    return collapse(F.when(c.contains("&"), reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), bare)).otherwise(bare))


def strip_accents(c: Column) -> Column:
    """STR-3"""
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{Mn}+", "")


def normalize(c: Column) -> Column:
    """STR-4: lower-case words of a-z and 0-9, single spaces; null is empty."""
    words = F.replace(F.lower(strip_accents(F.coalesce(c, F.lit("")))), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(words, r"[^a-z0-9]+", " "))  # a run at once, as one match costs as much as many letters


def clean_title(c: Column) -> Column:
    """STR-5: without markup and without trailing publisher names, however many."""
    names = "|".join(name.replace(" ", r"\s?") for name in PUBLISHERS)
    bare = strip_html(c)
    # without a mark, or an entity that may be one, there is no name to take off
    return F.trim(F.when(c.rlike("[|–—&-]"), F.regexp_replace(bare, rf"(?i)(?:\s*[|–—-]\s*(?:{names})(?:\.com)?\s*)+$", "")).otherwise(bare))


def normalize_title(c: Column) -> Column:
    """STR-6"""
    return normalize(clean_title(c))


def tokens(normalized: Column) -> Column:
    """STR-7: words of a normalised text that are longer than one letter and no stop words."""
    return F.filter(F.split(normalized, " "), lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))


def token_set(normalized: Column) -> Column:
    return F.array_distinct(tokens(normalized))


def slugify(c: Column, most: int = 80) -> Column:
    """STR-8"""
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(F.replace(normalize(c), F.lit(" "), F.lit("-")), 1, most), "-+$", ""), F.lit("")), F.lit("story"))


def truncate(c: Column, most: int, suffix: str = "...") -> Column:
    """STR-9: whole words up to the length, without trailing punctuation."""
    room = most - len(suffix)
    cut = F.regexp_replace(F.regexp_replace(F.substring(c, 1, room), r" [^ ]*$", ""), r"[ ,.;:-]+$", "")
    return F.when(F.length(c) > most, F.concat(cut, F.lit(suffix))).otherwise(c)


def sentences(c: Column) -> Column:
    """STR-10"""
    return F.split(collapse(c), r"(?<=[.!?])\s+(?=[A-Z0-9\"'“])")


def excerpt(c: Column, budget: int = 320) -> Column:
    """STR-11: whole sentences while they fit; the first is cut if it alone doesn't."""
    def step(acc: Column, s: Column) -> Column:
        longer = F.when(acc["t"] == "", s).otherwise(F.concat(acc["t"], F.lit(" "), s))
        fits = ~acc["full"] & (F.length(longer) <= budget)
        return F.struct(F.when(fits, longer).otherwise(acc["t"]).alias("t"), (~fits).alias("full"))

    start = F.struct(F.lit("").alias("t"), F.lit(False).alias("full"))
    return let(F.aggregate(sentences(c), start, step)["t"], lambda t: F.when(t == "", truncate(collapse(c), budget)).otherwise(t))


def quotes(c: Column) -> Column:
    """STR-12: quoted spans of 10 to 400 characters and at least four words."""
    return F.filter(F.regexp_extract_all(c, F.lit('["“]([^"“”]{10,400})["”]'), 1), lambda q: F.size(F.split(F.trim(q), r"\s+")) >= 4)


def jaccard(a: Column, b: Column) -> Column:
    """STR-13: 0 if either set is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    """STR-14: shared part of the smaller set; 0 if either is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def shares(a: Column, b: Column) -> Column:
    """STR-13, 14: (jaccard, overlap) of two sets without repeats, from one intersection."""
    n, m = F.size(a), F.size(b)
    some = lambda value: F.when((n == 0) | (m == 0), F.lit(0.0)).otherwise(value)
    return let(F.size(F.array_intersect(a, b)), lambda both: F.struct(some(both / (n + m - both)).alias("jaccard"), some(both / F.least(n, m)).alias("overlap")))


def set_similarity(a: Column, b: Column) -> Column:
    """STR-15: overlap of two lists of names, normalised."""
    names = lambda x: F.array_distinct(F.filter(F.transform(x, normalize), lambda n: n != ""))
    return overlap(names(a), names(b))


def title_similarity(a: Column, b: Column) -> Column:
    return overlap(token_set(normalize_title(a)), token_set(normalize_title(b)))


def merge_lists(a: Column, b: Column, most: int) -> Column:
    """STR-16: the lists one after the other, each name once whatever its spelling, cut at most."""
    keyed = F.transform(F.concat(a, b), lambda x: F.struct(normalize(x).alias("k"), x.alias("v")))
    step = lambda acc, x: F.when(F.exists(acc, lambda y: y["k"] == x["k"]) | (x["k"] == ""), acc).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(keyed, F.array().cast("array<struct<k:string,v:string>>"), step)
    return F.slice(F.transform(kept, lambda x: x["v"]), 1, most)


def clean_claim(c: Column) -> Column:
    """STR-17: without a leading "Report:" and a trailing "per sources", capitalised."""
    bare = F.regexp_replace(F.trim(c), r"(?i)^(?:report|breaking|update|exclusive|rumou?r|sources)\s*:\s*", "")
    bare = F.regexp_replace(bare, r"(?i)[,\s]+(?:per|according to)\s+(?:multiple\s+)?sources?\.?$", "")
    return F.concat(F.upper(F.substring(bare, 1, 1)), F.substring(bare, 2, 1 << 30))


def words_pattern(terms: Iterable[str]) -> str:
    """A pattern of any of the terms as whole words, in any case, with any white space between their words."""
    return rf"(?i)\b(?:{'|'.join(t.replace(' ', chr(92) + 's+') for t in terms)})\b"


def any_of(text: Column, terms: Iterable[str]) -> Column:
    """Whether a normalised text contains any of the terms."""
    return reduce(lambda a, b: a | b, (text.contains(t) for t in terms), F.lit(False))


#: What a word of a name goes on with, up to white space or a mark that ends a phrase.
IN_NAME = r"[^\s,;:!?()\[\]<>\"“”/|]"
#: A word that is written with a capital, and one of two letters or more.
CAPITALISED, NAME_PART = rf"[A-Z]{IN_NAME}*", rf"[A-Z]{IN_NAME}+"


def run_of(word: str, most: int) -> str:
    """A pattern of one to so many such words in a row."""
    return rf"{word}(?:\s+{word}){{0,{most - 1}}}"
