"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import decisions

    return decisions(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_rows

    return shard_rows(_table(spark, sf_dir, "documents").select("doc_id", "text"), [1.0] * 8)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.PATTERN)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import report

    return report(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive

    return archive(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ["doc_id"])


def op3_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score

    return score(_table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The rules of the contract, (action, host, path).
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op7_redirect_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)


def op11_pivotal_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), share=10, orders=(1, 1), buckets=10_000, seed=2024, least=20)


def op13_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .syncmers import report

    return report(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP2_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HOST = f"translate(regexp_extract({{u}}, '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"
_PATH = "regexp_extract({u}, '://[^/?#]*([^?#]*)', 1)"
_REST = "regexp_extract({u}, '://[^/?#]*([^#]*)', 1)"
_KEY = f"CASE WHEN {_HOST} <> '' THEN {_HOST} || CASE WHEN starts_with({_REST}, '/') THEN {_REST} ELSE '/' || {_REST} END END"
#: The rules' verdict for (host, path) rows of {src}, with the columns that identify them.
_MATCH = """SELECT x.*, m.rule, m.action FROM {src} x LEFT JOIN (SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS action
  FROM (SELECT DISTINCT host, path FROM {src}) d JOIN r ON (d.host = rh OR suffix(d.host, '.' || rh)) AND starts_with(d.path, rp) GROUP BY host, path) m ON x.host = m.host AND x.path = m.path"""
OP7_SQL = f"""
WITH RECURSIVE r(action, rh, rp) AS (VALUES {", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in URL_RULES)}),
u AS (SELECT page_id, url, html, coalesce({_HOST.format(u="url")}, '') AS host, coalesce({_PATH.format(u="url")}, '') AS path, {_KEY.format(u="url")} AS key FROM pages),
t AS (SELECT key, host, path, unnest(list_filter(regexp_extract_all(html, '(?i)(<(?:link|meta)\\b[^>]*>)', 1), lambda t: regexp_matches(t, '(?i)\\brel\\s*=\\s*[\\x22'']?canonical\\b')
  OR regexp_matches(t, '(?i)\\bhttp-equiv\\s*=\\s*[\\x22'']?refresh\\b'))) AS tag FROM u WHERE url IS NOT NULL),
h AS (SELECT key, host, regexp_extract(path, '^(.*/)', 1) AS folder, replace(CASE WHEN regexp_matches(tag, '(?i)^<link') THEN regexp_extract(tag, '(?i)\\bhref\\s*=\\s*[\\x22'']?([^\\x22''\\s>]+)', 1)
  ELSE regexp_extract(tag, '(?i)\\burl\\s*=\\s*[\\x22'']?([^\\x22''\\s>]+)', 1) END, '&amp;', '&') AS href FROM t),
a AS (SELECT key, CASE WHEN contains(href, '://') THEN href WHEN starts_with(href, '//') THEN 'http:' || href WHEN starts_with(href, '/') THEN 'http://' || host || href
  ELSE 'http://' || host || CASE WHEN folder = '' THEN '/' ELSE folder END || href END AS target FROM h WHERE href <> ''),
e AS (SELECT DISTINCT key AS x, {_KEY.format(u="target")} AS y FROM a WHERE key IS NOT NULL AND {_KEY.format(u="target")} IS NOT NULL),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
n0 AS (SELECT DISTINCT x AS key, {_HOST.format(u="'x://' || x")} AS host, {_PATH.format(u="'x://' || x")} AS path FROM b), n AS ({_MATCH.format(src="n0")}),
blocked(key) AS (SELECT key FROM n WHERE action = 'block' UNION SELECT b.y FROM blocked JOIN b ON b.x = blocked.key),
j AS ({_MATCH.format(src="u")})
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN key IN (SELECT key FROM blocked) THEN 'block' END, 'allow') AS verdict FROM j
"""


#: CRC-32 of the bytes that a column of hexadecimal digits spells, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(length({h}) // 2), lambda i: [('0x' || substr({h}, 2 * i + 1, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"""

#: Near words: equal but for the letter at one place, or one is the other without a letter.
OP11_SQL = f"""
WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS k, hex(encode(doc_id || ':' || run)) AS h FROM r GROUP BY ALL),
c AS (SELECT run, k, {_CRC.format(h="h")} AS crc FROM d),
w AS (SELECT CASE WHEN crc % 31 = 0 THEN substr(run, 1, (crc % length(run))::BIGINT) || substr(run, (crc % length(run))::BIGINT + 2) ELSE run END AS word, k FROM c),
v AS (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word AS word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN v b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN v b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS form, max(near_n) AS form_n FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * v.n THEN form END AS form, CASE WHEN form_n >= 10 * v.n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
up AS (SELECT word, word AS root FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM f JOIN up ON up.word = f.word JOIN f AS last ON last.word = up.root WHERE last.form IS NULL
"""

_WORDS = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT doc_id, unnest({_WORDS}) AS word FROM documents), b AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
v AS (SELECT word, {_CRC.format(h="h")} % 10000 AS bucket FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM d UNION SELECT word FROM b))),
s AS (SELECT bucket, count(*) AS s FROM d JOIN v USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM b JOIN v USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM d JOIN v USING (word) JOIN g USING (bucket) GROUP BY doc_id),
h AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM documents LEFT JOIN w USING (doc_id)),
c AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM h),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM c WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM k) // 100 THEN rank END AS rank FROM c LEFT JOIN k USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_grace_dedup": OP2_SQL, "op7_redirect_url_filter": OP7_SQL, "op11_pivotal_spelling": OP11_SQL, "op12_importance_resampling": OP12_SQL}
