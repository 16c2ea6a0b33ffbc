"""Lexicon classification (CLS-*): generated expressions over normalised titles and bodies."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CAPITALISED, let, normalize, run_of, words_pattern
from ..lexicons import CATEGORIES, CREDITS, DECISIVE, DENIAL, FUTURE_TERMS, INTENT_ORDER, INTENTS, OFFICIAL, OUTLETS, PRIORITY, RELIABLE, RESULT_VERBS, SPECULATION

Lexicon = dict[str, list[str]]


def plain(term: str) -> str:
    """A term as it stands in a normalised text."""
    import re

    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", term.lower().replace("&", " and "))).strip()


def _hit(text: Column, term: str) -> Column:
    """Short terms are whole words; longer ones may end a word ("ranking" in "rankings")."""
    t = plain(term)
    return F.concat(F.lit(" "), text, F.lit(" ")).contains(f" {t} ") if len(t) <= 4 else text.contains(t)


def _sought(terms: list[str]) -> Column:
    """Terms as they are looked for in a text between two spaces.  An array and a lambda instead of a branch
    for every term: generated code has a limit that a lexicon would exceed."""
    return F.array(*(F.lit(f" {plain(t)} " if len(plain(t)) <= 4 else plain(t)) for t in terms))


def _padded(text: Column) -> Column:
    return F.concat(F.lit(" "), text, F.lit(" "))


def has_term(text: Column, terms: list[str]) -> Column:
    """Whether a normalised text has any of the terms."""
    return let(_padded(text), lambda t: F.exists(_sought(terms), lambda x: t.contains(x)))


def score(title: Column, body: Column, terms: list[str]) -> Column:
    """CLS-1: 3 for a term in the title, else 1 for one in the body."""
    each = lambda both: F.aggregate(_sought(terms), F.lit(0), lambda n, x: n + F.when(both["t"].contains(x), 3).when(both["b"].contains(x), 1).otherwise(0))
    return let(F.struct(_padded(title).alias("t"), _padded(body).alias("b")), each)


def with_scores(rows: DataFrame, title: str, body: str, lexicon: Lexicon, prefix: str) -> DataFrame:
    """rows with a score column for every group of the lexicon."""
    return rows.withColumns({f"{prefix}{g}": score(F.col(title), F.col(body), terms) for g, terms in lexicon.items()})


def pick(prefix: str, priority: list[str], title: Column, lexicon: Lexicon, decisive: list[str], none: str = "general") -> Column:
    """CLS-2: decisive groups in the title first, then the best score, ties by priority."""
    best = F.greatest(*(F.col(f"{prefix}{g}") for g in priority), F.lit(0))
    by_score = reduce(lambda c, g: c.when(F.col(f"{prefix}{g}") == best, g), priority, F.when(best == 0, F.lit(none)))
    firm = [F.when(has_term(title, lexicon[g]), F.lit(g)) for g in decisive]
    return F.coalesce(*firm, by_score)


def attributions(raw: Column, own: Column, outlets: list[str] = OUTLETS, most: int = 4) -> Column:
    """CLS-5: outlets credited by "according to X" and the like, in order, but for the article's own."""
    phrases = "|".join(words.replace(" ", r"\s+") for words in CREDITS)
    credit = F.lit(rf"\b(?:{phrases})\s+({run_of(CAPITALISED, 4)})")
    known = lambda s, self_name: F.coalesce(*(F.when(s.contains(plain(o)) & ~self_name.contains(plain(o)), F.lit(o)) for o in outlets))
    # both sides are normalised once, not for every outlet that they are held against
    found = lambda self_name: F.transform(F.transform(F.regexp_extract_all(raw, credit, 1), normalize), lambda s: known(s, self_name))
    return F.slice(F.array_distinct(F.array_compact(let(normalize(F.coalesce(own, F.lit(""))), found))), 1, most)


def is_promotional(category: Column) -> Column:
    """CLS-6: previews, odds and the like, and interviews, bring little news."""
    return category.isin("promo", "interview")


def intent(raw_title: Column, raw_body: Column, prefix: str, in_title: Callable[[str], Column]) -> Column:
    """CLS-7: what an article is doing; a headline outranks a body, and nothing to come is a result.

    in_title: whether a group of the intents has a term in the title."""
    done, coming = words_pattern(RESULT_VERBS), words_pattern(FUTURE_TERMS)
    results, said = F.col(f"{prefix}RESULT") > 0, F.struct(raw_title.rlike(done).alias("verb"), raw_title.rlike(coming).alias("ahead"))
    best = F.greatest(*(F.col(f"{prefix}{g}") for g in INTENT_ORDER))
    leader = reduce(lambda c, g: c.when(F.col(f"{prefix}{g}") == best, g), INTENT_ORDER, F.when(best == 0, F.lit("UNKNOWN")))

    def told(verb: Column, ahead: Column) -> Column:
        return (
            F.when(in_title("PREDICTION"), F.lit("PREDICTION"))
            .when(raw_title.rlike(r"\?\s*$") & results, "PREVIEW")
            .when(ahead & (verb | results | in_title("PREVIEW")), "PREVIEW")
            .when(in_title("PREVIEW") & ~verb, "PREVIEW")
            .otherwise(let(leader, lambda x: F.when((x == "RESULT") & ~verb & ~raw_body.rlike(done), F.lit("PREVIEW")).otherwise(x)))
        )

    return let(said, lambda s: told(s["verb"], s["ahead"]))


def may_establish_result(intent_col: Column, source_type: Column) -> Column:
    """CLS-8: previews and predictions never do."""
    return F.coalesce(intent_col.isin("RESULT", "POST_FIGHT") & source_type.isin(RELIABLE), F.lit(False))


#: Source types with their default weights, and two labels of social accounts.
WEIGHTS = {"OFFICIAL": 1.0, "MAJOR_NEWS": 0.85, "ESTABLISHED_JOURNALIST": 0.8, "TRUSTED_REPORTER": 0.7, "INSIDER": 0.5, "FIGHTER": 0.55, "COACH_TEAM": 0.5, "PROMOTER": 0.5, "UNKNOWN": 0.3, "FAN_ACCOUNT": 0.15}
LABELS = {"TRUSTED_JOURNALIST": "ESTABLISHED_JOURNALIST", "ESTABLISHED_REPORTER": "TRUSTED_REPORTER"}
CREDIBLE = ["OFFICIAL", "MAJOR_NEWS", "ESTABLISHED_JOURNALIST", "TRUSTED_REPORTER"]
FIRST_PERSON = ["FIGHTER", "COACH_TEAM", "PROMOTER"]
LOW = ["UNKNOWN", "FAN_ACCOUNT"]


def source_type(label: Column) -> Column:
    """CLS-12: any label as a source type."""
    raw = F.regexp_replace(F.regexp_replace(F.upper(F.trim(F.coalesce(label, F.lit("")))), "[ /]", "_"), "COACH_+TEAM", "COACH_TEAM")
    named = reduce(lambda c, kv: c.when(raw == kv[0], kv[1]), list(LABELS.items())[1:], F.when(raw == next(iter(LABELS)), F.lit(next(iter(LABELS.values())))))
    return named.when(raw.isin(list(WEIGHTS)), raw).otherwise("UNKNOWN")


def reliability(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, F.lit(w)) for k, w in WEIGHTS.items()), F.lit(0.3))


def longest_of(words: list[str]) -> str:
    """A pattern of any of the words, the longest where one begins another: words of a-z, 0-9 and spaces by their
    common beginnings, so a place of a text is held against first letters instead of against every word."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    ends = heads.pop("", None) is not None
    if not heads:
        return "" if words else "(?!)"
    each = [h + longest_of(rest) for h, rest in heads.items()]
    many = each[0] if len(each) == 1 and not ends else f"(?:{'|'.join(each)})"
    return f"{many}?" if ends else many


class Hits:
    """All terms of several lexicons, looked up in one pass.

    Every term carries the groups that it belongs to as bits of a number.  A row gets the array of the terms
    that it has, with whether its title does; scores, flags, keywords and the terms behind a flag are read
    from that short array instead of from the text.  Terms of the whole groups may run from the title into the body."""

    def __init__(self, groups: Lexicon, whole: Lexicon) -> None:
        self.bits = {g: 1 << k for k, g in enumerate([*groups, *whole])}
        if len(self.bits) > 62:
            raise ValueError("more than 62 groups")
        masks: dict[tuple[str, str, bool], int] = {}
        for names, far in ((groups, False), (whole, True)):
            for g, terms in names.items():
                for term in terms:
                    t = plain(term)
                    # short terms are whole words, but for official words and denials, which are parts of words too
                    key = (term, f" {t} " if len(t) <= 4 and not g.startswith("~") else t, far)
                    masks[key] = masks.get(key, 0) | self.bits[g]
        crossing = {k: m for k, m in masks.items() if k[2]}
        self.every, self.crossing = self._by_longest(masks), self._by_longest(crossing)
        self.reach = max((len(x) for _, x, _ in crossing), default=0)

    @staticmethod
    def _by_longest(masks: dict[tuple[str, str, bool], int]) -> tuple[str, Column]:
        """A pattern that gives the longest term at every place of a text, and what each stands for: itself
        and the terms that it begins with, as no others can begin where it does."""
        keys = sorted({x for _, x, _ in masks})
        terms = {k: [(term, x, mask) for (term, x, _), mask in masks.items() if k.startswith(x)] for k in keys}
        told = lambda t: F.struct(F.lit(t[0]).alias("term"), F.lit(t[1]).alias("x"), F.lit(t[2]).cast("long").alias("mask"))
        known = F.create_map(*(c for k in keys for c in (F.lit(k), F.array(*map(told, terms[k]))))) if keys else F.create_map().cast("map<string,array<struct<term:string,x:string,mask:bigint>>>")
        return f"(?=({longest_of(keys)}))", known

    def find(self, title: Column, body: Column) -> Column:
        """array<(term, mask, t)>: one pass over title and body with a mark between them that no term has, and one
        over the place where they meet, for the terms that may run from one into the other; only what is found is
        looked for in the title again."""
        text = F.concat_ws(" \u0001 ", F.concat(F.lit(" "), title), F.concat(body, F.lit(" ")))
        seam = F.concat_ws(" ", F.right(title, F.lit(self.reach)), F.left(body, F.lit(self.reach)))

        def within(text: Column, sought: tuple[str, Column]) -> Column:
            pattern, known = sought
            return F.flatten(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1)), lambda x: known[x]))

        found = F.array_distinct(F.concat(within(text, self.every), within(seam, self.crossing)) if self.reach else within(text, self.every))
        return let(_padded(title), lambda t: F.transform(found, lambda k: F.struct(k["term"].alias("term"), k["mask"].alias("mask"), t.contains(k["x"]).alias("t"))))

    def _of(self, group: str):
        return lambda h: h["mask"].bitwiseAND(F.lit(self.bits[group])) != 0

    def score(self, hits: Column, group: str) -> Column:
        """CLS-1: 3 for a term in the title, else 1."""
        of = self._of(group)
        return F.aggregate(hits, F.lit(0), lambda n, h: n + F.when(of(h), F.when(h["t"], 3).otherwise(1)).otherwise(0))

    def in_title(self, hits: Column, group: str) -> Column:
        of = self._of(group)
        return F.exists(hits, lambda h: of(h) & h["t"])

    def matched(self, hits: Column, groups: list[str]) -> Column:
        """The terms of these groups that a row has, each once."""
        mask = F.lit(sum(self.bits[g] for g in groups)).cast("long")
        return F.array_sort(F.array_distinct(F.transform(F.filter(hits, lambda h: h["mask"].bitwiseAND(mask) != 0), lambda h: h["term"])))

    def count(self, hits: Column, group: str) -> Column:
        return F.size(F.filter(hits, self._of(group)))


def computed(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """rows with these columns, each worked out once per row.  Projections on top of each other are merged, and
    what several columns use would be worked out for each of them; a generator of one row isn't merged."""
    made = F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items()))))
    return rows.select(*(F.col(f"`{c}`") for c in rows.columns if c not in columns), made)


def _article_hits(categories: Lexicon) -> Hits:
    return Hits({f"c_{g}": t for g, t in categories.items()} | {f"i_{g}": t for g, t in INTENTS.items()}, {"speculation": SPECULATION, "~official": OFFICIAL, "~denial": DENIAL})


def _picked(hits: Hits, found: Column, prefix: str, priority: list[str], decisive: list[str], none: str = "general") -> Column:
    """CLS-2 from hits and score columns."""
    best = F.greatest(*(F.col(f"{prefix}{g}") for g in priority), F.lit(0))
    by_score = reduce(lambda c, g: c.when(F.col(f"{prefix}{g}") == best, g), priority, F.when(best == 0, F.lit(none)))
    return F.coalesce(*(F.when(hits.in_title(found, f"{prefix}{g}"), F.lit(g)) for g in decisive), by_score)


def _flags(hits: Hits, found: Column) -> dict[str, Column]:
    """CLS-3, 4: how hedged, and official words and denials with the terms that show them."""
    official, denial = hits.matched(found, ["~official"]), hits.matched(found, ["~denial"])
    return {
        "speculation_score": F.round(F.least(F.lit(1.0), hits.count(found, "speculation") / 3), 3),
        "official_terms": official,
        "denial_terms": denial,
        "has_official_language": F.size(official) > 0,
        "has_denial": F.size(denial) > 0,
    }


def _categorised(articles: DataFrame, hits: Hits, priority: list[str], decisive: list[str], more: dict[str, Column]) -> DataFrame:
    """CLS-1, 2, 7, 9: articles with hits__, scores, category_raw, intent, category and the columns that are worked out beside these."""
    found = F.col("hits__")
    rows = computed(articles, {"title__": normalize(F.col("title")), "body__": normalize(F.col("body"))})
    rows = computed(rows, {"hits__": hits.find(F.col("title__"), F.col("body__"))}).drop("title__", "body__")
    rows = computed(rows, {k: hits.score(found, k) for k in hits.bits if k[:2] in ("c_", "i_")})
    picked = {"category_raw": _picked(hits, found, "c_", priority, decisive), "intent": intent(F.col("title"), F.col("body"), "i_", lambda g: hits.in_title(found, f"i_{g}"))}
    rows = computed(rows, picked | more)
    weak = (F.col("category_raw") == "result") & F.col("intent").isin("PREVIEW", "PREDICTION")
    rows = rows.withColumn("category", F.when(weak, F.lit("general")).otherwise(F.col("category_raw")))  # CLS-9
    return rows.drop("category_raw", "hits__", *(k for k in hits.bits if k[:2] in ("c_", "i_")))


def categorise(articles: DataFrame, categories: Lexicon = CATEGORIES, priority: list[str] = PRIORITY, decisive: list[str] = DECISIVE) -> DataFrame:
    """CLS-2, 7, 9: articles (title, body) with category and intent as `enrich` has them, and nothing else worked out."""
    hits = Hits({f"c_{g}": t for g, t in categories.items()} | {f"i_{g}": t for g, t in INTENTS.items()}, {})
    return _categorised(articles, hits, priority, decisive, {})


def enrich(articles: DataFrame, categories: Lexicon = CATEGORIES, priority: list[str] = PRIORITY, decisive: list[str] = DECISIVE, most: int = 15) -> DataFrame:
    """CLS-10: articles (title, body, source_name, source_type) with every CLS column.  One pass, no shuffle.

    Where articles have keywords of their own, these come first, and all are `most` at most."""
    hits = _article_hits(categories)
    found = F.col("hits__")
    own = F.slice(hits.matched(found, [f"c_{g}" for g in categories]), 1, 12)
    rows = _categorised(
        articles,
        hits,
        priority,
        decisive,
        {
            "keywords": F.slice(F.array_distinct(F.concat(F.coalesce("keywords", F.array().cast("array<string>")), own)), 1, most) if "keywords" in articles.columns else own,
            **_flags(hits, found),
            "attribution_outlets": attributions(F.concat_ws(" ", "title", "body"), F.col("source_name")),
        },
    )
    return rows.withColumns(
        {
            "is_derivative": F.size("attribution_outlets") > 0,
            "is_official": (source_type(F.col("source_type")) == "OFFICIAL") & (F.size("attribution_outlets") == 0),
            "may_establish_result": may_establish_result(F.col("intent"), F.col("source_type")),
        }
    )


def enrich_posts(posts: DataFrame, categories: Lexicon = CATEGORIES, priority: list[str] = PRIORITY, decisive: list[str] = DECISIVE) -> DataFrame:
    """CLS-11: posts (text, username, account_type) with what they are about, how hedged, and who says it.

    account_type is that of JOIN-3; a post has a text and no headline, so its text counts as one."""
    hits = Hits({f"c_{g}": t for g, t in categories.items()}, {"speculation": SPECULATION, "~official": OFFICIAL, "~denial": DENIAL})
    found = F.col("hits__")
    rows = computed(posts, {"text__": normalize(F.col("text"))})
    rows = computed(rows, {"hits__": hits.find(F.col("text__"), F.lit(""))}).drop("text__")
    rows = computed(rows, {k: hits.score(found, k) for k in hits.bits if k.startswith("c_")})
    rows = computed(
        rows,
        {
            "account_type": source_type(F.col("account_type")),
            "category": _picked(hits, found, "c_", priority, decisive),
            **_flags(hits, found),
            "attribution_outlets": attributions(F.col("text"), F.col("username")),
        },
    )
    return rows.withColumn("reliability_weight", reliability(F.col("account_type"))).drop("hits__", *(f"c_{g}" for g in categories))


def missing_details(category: Column, events: Column, text: Column) -> Column:
    """CLS-14: what a report of this category leaves open, five at most."""
    bout = category.isin("fight_announcement", "cancellation", "replacement")

    def checks(text: Column) -> Column:
        return F.array(
            F.when(bout & (F.size(events) == 0), F.lit("event not named")),
            F.when(bout & ~text.rlike(r"\b(january|february|march|april|may|june|july|august|september|october|november|december)\b"), F.lit("no date given")),
            F.when((category == "fight_announcement") & ~text.contains("weight"), F.lit("weight class not stated")),
            F.when((category == "injury") & ~text.rlike(r"\b(weeks?|months?|surgery)\b"), F.lit("no recovery timeline")),
            F.when((category == "cancellation") & ~text.contains("replac"), F.lit("no replacement named")),
            F.when(category.isin("controversy", "suspension") & ~text.rlike(r"\bstatement\b"), F.lit("no official statement")),
        )

    return F.slice(F.array_compact(let(text, checks)), 1, 5)


def grounded(generated: Column, source: Column) -> Column:
    """CLS-13: figures and quotes of a generated text that its source doesn't hold."""
    src = normalize(source)
    figures = F.array_distinct(F.regexp_extract_all(generated, F.lit(r"(\d+-\d+(?:-\d+)?|[$€£]\d[\d,.]*|\d+(?:\.\d+)?%)"), 1))
    wrong = F.filter(figures, lambda f: ~F.concat(F.lit(" "), src, F.lit(" ")).contains(F.concat(F.lit(" "), normalize(f), F.lit(" "))))
    said = F.regexp_extract_all(generated, F.lit('["“]([^"“”]{10,400})["”]'), 1)

    def runs(words: Column, size: int) -> Column:
        steps = F.sequence(F.lit(1), F.greatest(F.size(words) - size + 1, F.lit(1)))
        return F.exists(steps, lambda i: src.contains(F.array_join(F.slice(words, i, size), " ")))

    def held(q: Column) -> Column:
        words = F.split(normalize(q), " ")
        return src.contains(normalize(q)) | ((F.size(words) >= 8) & (runs(words, 8) | runs(words, 6)))

    return F.struct(wrong.alias("figures"), F.filter(said, lambda q: ~held(q)).alias("quotes"))
