"""Personal data by weak supervision, in DataFrame functions only.

Fixed patterns give the base spans, which always stand.  A wider set of patterns gives further
candidates (national phone numbers, spelled-out addresses, other card lengths, identity numbers,
credentials, titled names).  Five labelers vote +1, 0 or -1 on every candidate: the base pattern
with its check, gazetteers (domains, card issuers, country codes, first names, reserved
addresses), words just before it, its shape, and what it touches.  Spark counts the vote patterns
over all documents - a table of at most kinds times 3 ** labelers rows - and from it expectation
maximisation estimates each labeler's reliability without labels, and a logistic span classifier
is fitted to the posteriors.  Candidates that the classifier is sure of are added where they touch
no base span.

Offsets are code points.  Null text is empty: no spans; redaction leaves it null.  Of added candidates
in one place, or that overlap, the one that starts first stays, then the longer, then the kind listed
first.  Repeated rows and ids are each judged by themselves; other columns pass redaction as they
are, whatever their names; an empty table gives an empty result and a model that adds nothing.
Texts are read whole at any length, in time that grows with the text and its matches: running sums
over matches go by blocks, and cuts are taken from pieces of the text.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Kinds in the order of the result; the first four have base patterns.
KINDS = ["email", "ip", "card", "phone", "secret", "id", "name"]
BASE = KINDS[:4]
#: The base patterns, each equal to the plain form in the comment.  Possessive repeats, and starts
#: only where a run of the first class starts (or the last match ended), keep them linear.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ of 16 to 19 digits: whole runs only
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
EXTRA = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{2,63}+ ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,10}+",
    "card": r"(?<![0-9.])(?<![0-9][\x20-])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9+().-])(?<!\+[0-9][\x20])\(?[2-9][0-9]{2}\)?[\x20.-][2-9][0-9]{2}[.-][0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_])(?:token|api_?key|secret|password|passwd)\x20?[=:]\x20?[\x22']?[A-Za-z0-9_/+-]{16,128}+",
    "id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"(?<![A-Za-z])(?:Mrs?|Ms|Dr|Prof)\.?\x20[A-Z][a-z]{1,20}\x20[A-Z][a-z]{1,20}(?![A-Za-z])",
}
LABELERS = ["pattern", "gazetteer", "context", "shape", "touch"]
#: Characters before a candidate that the context labeler reads.
CONTEXT = 32
#: Elements of a running fold, and characters of a text, that are handled together.
BLOCK, PIECE = 128, 4096
SURE = 0.9
NEVER = (1 << 31) - 1

#: Gazetteers and cues.
DOMAINS = "com org net edu gov io info de fr es it uk eu ch at nl be pl us ca au br mx jp"
COUNTRIES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 420"
NAMES = "james mary john anna maria peter paul susan linda david michael sarah laura thomas marie pierre jean hans karl jose juan carmen elena"
CUES = {
    "email": "mail|contact|write|reach",
    "ip": r"\bip\b|host|server|address|login",
    "card": "card|visa|master|amex|payment|credit",
    "phone": r"phone|\btel|call|fax|mobil|contact|whatsapp",
    "secret": "api|auth|config|export|env",
    "id": r"ssn|social|security|passport|\bid\b",
    "name": "contact|by|from|dear|patient|client",
}
AGAINST = r"version|isbn|\border|invoice|figure|page|chapter|\bv$|[$€£%=]\s*$"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _parts(text: Column, pattern: str) -> Column:
    """The text around and in the matches, by turns.  U+0001 marks; one in the text is replaced,
    by a character that no pattern reads either, before it is split."""
    marked = F.regexp_replace(F.translate(text, "\u0001", "\u0002"), F.lit(f"({pattern})"), F.lit("\u0001$1\u0001"))
    return F.split(marked, "\u0001", -1)


def running(values: Column, fold: Callable[[Column, Column], Column], start: int) -> Column:
    """The fold of an array of ints up to and with each element.  An array grows by copying itself, so
    it is folded in blocks, and then over the blocks."""
    empty = F.array().cast("array<int>")
    step = lambda acc, x: F.struct(fold(acc["at"], x).alias("at"), F.concat(acc["all"], F.array(fold(acc["at"], x))).alias("all"))
    scan = lambda a: F.aggregate(a, F.struct(F.lit(start).alias("at"), empty.alias("all")), step)["all"]

    def placed(inner: Column) -> Column:
        before = F.concat(F.array(F.lit(start)), scan(F.transform(inner, lambda x: F.element_at(x, -1))))
        return let(before, lambda b: F.flatten(F.transform(inner, lambda x, i: F.transform(x, lambda y: fold(F.get(b, i), y)))))

    def blocks(v: Column) -> Column:
        many = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        return F.when(F.size(v) > 0, let(F.transform(many, lambda k: scan(F.slice(v, k * BLOCK + 1, F.lit(BLOCK)))), placed)).otherwise(empty)

    return let(values, blocks)


def _ends(parts: Column) -> Column:
    """Code points up to the end of each part."""
    return running(F.transform(parts, F.length), lambda a, b: a + b, 0)


def _valid(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "ip":
        small = lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) <= 3) & (F.coalesce(F.nullif(q, F.lit("")).try_cast("int"), F.lit(0)) <= 255))
        return F.forall(F.split(v, r"\."), small)
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, F.lit(-1)).when(yes, F.lit(1)).otherwise(F.lit(0)).cast("tinyint")


def _alternatives(words: str) -> str:
    return "|".join(words.split())


def _votes(kind: str, base: bool, ok: Column, v: Column, before: Column, after: Column) -> list[Column]:
    never, digits = F.lit(False), F.regexp_replace(v, "[^0-9]", "")
    gazetteer = {
        "email": _vote(F.lower(v).rlike(rf"[.)\] ]({_alternatives(DOMAINS)})$"), never),
        "ip": _vote(never, v.rlike(r"^(0|10|127|169\.254|192\.168|255)\.")),
        "card": _vote(digits.rlike("^(4|5[1-5]|2[2-7]|3[47]|35|6011|65)"), digits.rlike("^[01789]")),
        "phone": _vote(v.rlike(rf"^\+({_alternatives(COUNTRIES)})(?![0-9])|^\+1|555") if base else v.rlike(r"555[.-]"), digits.rlike("^0{3}")),
        "secret": _vote(v.rlike(r"[0-9a-f]{32,}$"), v.rlike("[xX*]{8}")),
        "id": _vote(~v.rlike("^(000|666|9)"), v.rlike("^(000|666|9)|-00-|-0000$")),
        "name": _vote(F.lower(v).rlike(rf"\b({_alternatives(NAMES)})\b"), never),
    }[kind]
    shape = {
        "email": _vote(F.length(v) <= 254, v.rlike(r"\.\.|^\.|@-")),
        "ip": _vote(~v.rlike(r"(^|\.)0[0-9]"), v.rlike(r"(^|\.)0[0-9]")),
        "card": _vote(v.rlike(r"^([0-9]{4}[\x20-]?){3}[0-9]{4,7}$|^3[47]"), digits.rlike(r"^([0-9])\1+$")),
        "phone": _vote(v.rlike(r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-]?[0-9]{4}$"), v.rlike(r"[().\x20-]{4}") | digits.rlike(r"([0-9])\1{7}")),
        "secret": _vote(v.rlike("[0-9]") & v.rlike("[a-z]"), ~v.rlike("[0-9]")),
        "id": _vote(F.lit(True), digits.rlike(r"^([0-9])\1+$")),
        "name": _vote(F.lit(True), never),
    }[kind]
    pattern = F.when(ok, F.lit(1)).otherwise(F.lit(-1)).cast("tinyint") if base else F.lit(0).cast("tinyint")
    context = let(F.lower(before), lambda c: _vote(c.rlike(CUES[kind]), c.rlike(AGAINST) if kind != "secret" else never))
    # a letter of the sentence before an address is ordinary where the pattern takes letters itself
    touch = _vote(~before.rlike(r"[\p{L}0-9]$") & ~after.rlike(r"^[\p{L}0-9]"), before.rlike(r"[0-9]$") | after.rlike(r"^[0-9]"))
    return [pattern, gazetteer, context, shape, touch]


def _found(text: Column, kind: str, pattern: str, base: bool, worth: Column) -> Column:
    """Candidates of one kind: kind, base (a valid base span), start, end, one vote for each labeler."""

    def span(parts: Column, ends: Column, i: Column) -> Column:
        at = lambda k: F.get(parts, k)
        return let(
            F.struct(at(i).alias("v"), F.right(at(i - 1), F.lit(CONTEXT)).alias("before"), F.left(at(i + 1), F.lit(2)).alias("after")),
            lambda c: F.struct(
                F.lit(kind).alias("kind"),
                (_valid(kind, c["v"]) if base else F.lit(False)).alias("base"),
                F.get(ends, i - 1).alias("start"),
                F.get(ends, i).alias("end"),
                *(vote.alias(n) for n, vote in zip(LABELERS, _votes(kind, base, _valid(kind, c["v"]), c["v"], c["before"], c["after"]), strict=True)),
            ),
        )

    def spans(parts: Column) -> Column:
        odd = F.when(F.size(parts) > 2, F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
        return let(_ends(parts), lambda ends: F.transform(odd, lambda i: span(parts, ends, i)))

    kinds = f"array<struct<kind:string,base:boolean,start:int,end:int,{','.join(f'{n}:tinyint' for n in LABELERS)}>>"
    return F.when(worth, let(_parts(text, pattern), spans)).otherwise(F.array().cast(kinds)).cast(kinds)


def candidates(text: Column) -> Column:
    """All candidates of a text, in the order of KINDS and then by start."""
    worth = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(PATTERNS["card"]), "phone": text.rlike(r"\+[0-9]")}
    more = {"email": text.rlike(r"[(\[]at[)\]]"), "secret": text.rlike("token|key|secret|passw")}
    lists = [_found(text, k, p, True, worth[k]) for k, p in PATTERNS.items()]
    lists += [_found(text, k, p, False, more.get(k, text.rlike(p))) for k, p in EXTRA.items()]
    return F.concat(*lists)


def fit(rows: list[dict], rounds: int = 50) -> dict:
    """Labelers' reliabilities by expectation maximisation, and the classifier fitted to its posteriors.

    rows: kind, one vote for each labeler, n.  Returns the weights of the classifier's log-odds."""
    if not rows:
        return {"bias": {k: -9.0 for k in KINDS}, "weight": {}, "reliability": {}}
    vote = lambda r: [r[n] for n in LABELERS]
    truth = [1 / (1 + math.exp(-sum(vote(r)))) for r in rows]  # at first, the majority
    for _ in range(rounds):
        mass = [sum(r["n"] * (t if c else 1 - t) for r, t in zip(rows, truth, strict=True)) for c in (0, 1)]
        given = [{(k, v, c): (1 + sum(r["n"] * (t if c else 1 - t) for r, t in zip(rows, truth, strict=True) if r[n] == v)) / (3 + mass[c]) for v in (-1, 0, 1) for c in (0, 1)} for k, n in enumerate(LABELERS)]
        prior = {k: (1 + sum(r["n"] * t for r, t in zip(rows, truth, strict=True) if r["kind"] == k)) / (2 + sum(r["n"] for r in rows if r["kind"] == k)) for k in KINDS}
        odds = [math.log(prior[r["kind"]] / (1 - prior[r["kind"]])) + sum(math.log(g[k, v, 1] / g[k, v, 0]) for k, (g, v) in enumerate(zip(given, vote(r), strict=True))) for r in rows]
        truth = [1 / (1 + math.exp(-max(-30, min(30, o)))) for o in odds]
    # logistic regression on the votes, by gradient steps over the table of vote patterns
    weight = {(n, v): 0.0 for n in LABELERS for v in (-1, 1)}
    bias = {k: 0.0 for k in KINDS}
    total = sum(math.sqrt(r["n"]) for r in rows)  # so that a frequent pattern doesn't drown the others
    for _ in range(400):
        slope, lean = dict.fromkeys(weight, 0.0), dict.fromkeys(bias, 0.0)
        for r, t in zip(rows, truth, strict=True):
            on = [(n, r[n]) for n in LABELERS if r[n]]
            z = bias[r["kind"]] + sum(weight[f] for f in on)
            error = math.sqrt(r["n"]) * (1 / (1 + math.exp(-z)) - t) / total
            lean[r["kind"]] += error
            for f in on:
                slope[f] += error
        for f in weight:
            weight[f] -= 2 * (slope[f] + 1e-3 * weight[f])
        for k in bias:
            bias[k] -= 2 * (lean[k] + 1e-3 * bias[k])
    return {"bias": bias, "weight": weight, "reliability": {n: g[k, 1, 1] / (g[k, 1, 0] + g[k, 1, 1]) for k, (n, g) in enumerate(zip(LABELERS, given, strict=True))}}


def learn(found: DataFrame) -> dict:
    """The model from a table with the column found (candidates), over all of its rows."""
    votes = found.select(F.explode("found").alias("c")).groupBy("c.kind", *(f"c.{n}" for n in LABELERS)).agg(F.count(F.lit(1)).alias("n"))
    rows = sorted((r.asDict() for r in votes.collect()), key=str)  # at most 7 * 3 ** 5 rows
    return fit(rows)


def decide(found: Column, model: dict) -> Column:
    """The spans that stand: base ones, and added ones that touch none of them or of each other's."""
    if not model["weight"]:
        return F.filter(found, lambda c: c["base"])

    def sure(c: Column) -> Column:
        z = F.element_at(F.create_map(*(x for k, b in model["bias"].items() for x in (F.lit(k), F.lit(b)))), c["kind"])
        for (n, v), w in model["weight"].items():
            z = z + F.when(c[n] == v, F.lit(w)).otherwise(F.lit(0.0))
        # what fails a base pattern's own check teaches the model, but is never added
        return (c["pattern"] >= 0) & (z > math.log(SURE / (1 - SURE)))

    def ordered(found: Column) -> Column:
        place = lambda c: F.array_position(F.array(*map(F.lit, KINDS)), c["kind"])
        return F.array_sort(F.transform(found, lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("longest"), place(c).alias("place"), c.alias("c"))))

    def both(rows: Column) -> Column:
        """Of spans in order, those before one reach over it if the furthest of them does, those after it if the next one does."""
        ends = lambda base: F.transform(rows, lambda x: F.when(x["c"]["base"] == base, x["c"]["end"]).otherwise(F.lit(-1)))
        starts = F.transform(rows, lambda x: F.when(x["c"]["base"], x["start"]).otherwise(F.lit(NEVER)))
        nearest = F.reverse(running(F.reverse(starts), F.least, NEVER))
        far = F.struct(running(ends(True), F.greatest, -1).alias("base"), running(ends(False), F.greatest, -1).alias("rest"), nearest.alias("next"))

        def stands(x: Column, i: Column, far: Column) -> Column:
            free = (F.get(far["base"], i) <= x["start"]) & (F.get(far["next"], i) >= x["c"]["end"])
            lone = F.coalesce(F.get(far["rest"], i - 1), F.lit(-1)) <= x["start"]
            return x["c"]["base"] | (free & lone & sure(x["c"]))

        return let(far, lambda f: F.transform(F.filter(rows, lambda x, i: stands(x, i, f)), lambda x: x["c"]))

    return F.when(F.exists(found, lambda c: ~c["base"]), let(ordered(found), both)).otherwise(found)


def listed(spans: Column) -> Column:
    """kind:start:end, by kind and start, comma-joined."""
    order = lambda c: F.array_position(F.array(*map(F.lit, KINDS)), c["kind"])
    inner = F.array_sort(F.transform(spans, lambda c: F.struct(order(c).alias("o"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
    return F.array_join(F.transform(inner, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    found = materialise(docs.select(F.col(f"`{id_col}`").alias("key"), candidates(text).alias("found")), "spans")
    model = learn(found)
    base = F.filter("found", lambda c: c["base"])
    number = lambda kind: F.size(F.filter("found", lambda c: c["base"] & (c["kind"] == kind))).cast("long")
    counts = [number(kind).alias(f"n_{kind}") for kind in BASE]
    return found.select(F.col("key").alias(id_col), *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(decide(F.col("found"), model)).alias("spans"))


def _without(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind; of spans that overlap, the later gives what the earlier left."""
    ordered = F.array_sort(F.transform(spans, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))

    def cut(pieces: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / PIECE).cast("int")
        some = F.slice(pieces, first + 1, F.floor((b - 1) / PIECE).cast("int") - first + 1)
        return F.when(a < b, F.substring(F.array_join(some, ""), a - first * PIECE + 1, b - a)).otherwise(F.lit(""))

    def rebuilt(x: Column) -> Column:
        at = lambda i: F.coalesce(F.get(x["reach"], i - 1), F.lit(0))
        parts = F.transform(x["spans"], lambda c, i: F.concat(cut(x["pieces"], at(i), F.greatest(c["start"], at(i))), F.lit("["), F.upper(c["kind"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), cut(x["pieces"], F.element_at(x["reach"], -1), x["size"]))

    def read(spans: Column) -> Column:
        reach = running(F.transform(spans, lambda c: c["end"]), F.greatest, 0)
        pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
        return let(F.struct(spans.alias("spans"), reach.alias("reach"), pieces.alias("pieces"), F.length(text).alias("size")), rebuilt)

    return let(ordered, read)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with each span replaced by its kind in brackets; length_col, if given, is set anew."""
    name = "found"
    while name in docs.columns:
        name += "_"
    # written once with its candidates, from which the model is learnt and the text is made
    rows = materialise(docs.withColumn(name, candidates(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))), "candidates")
    model = learn(rows.select(F.col(name).alias("found")))
    text = F.col(f"`{text_col}`")
    clean = let(decide(F.col(name), model), lambda spans: F.when(F.size(spans) > 0, _without(text, spans)).otherwise(text))
    out = rows.withColumn(text_col, F.when(F.size(name) > 0, clean).otherwise(text)).drop(name)
    return out.withColumn(length_col, F.length(F.col(f"`{text_col}`")).cast(dict(docs.dtypes)[length_col])) if length_col else out
