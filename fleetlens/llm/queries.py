"""The registered query of every operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import bpe_tree, dac_tokens, hnsw_dedup, lang_nb, license_scan, packing, prefix_trie, quality_mil, simhash_pivot, spaced_seed, spelling, url_reputation, warc_store
from fleetlens.llm.common import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "warc")
    warc_store.write(_read(spark, sf_dir, "pages"), "page_id", "url", "html", out)
    found = warc_store.read(spark, out, payload_bytes=F.octet_length("payload").cast("long"), payload_digest=F.sha1("payload"))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


_OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS response FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id <> response THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> response THEN response END AS refers_to
FROM d LEFT JOIN g USING (payload_digest)
"""

RULES = [
    url_reputation.Rule("allow", "com", "/"),
    url_reputation.Rule("block", "example.com", "/en/"),
    url_reputation.Rule("allow", "www.example.com", "/en/"),
    url_reputation.Rule("block", "net", "/es/"),
    url_reputation.Rule("block", "net", "/fr/"),
]


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows a document: its number ends the path. The document's quality label is the outcome of the page."""
    pages = _read(spark, sf_dir, "pages")
    number = F.regexp_extract(url_reputation.path_of("url"), r"/([0-9]{1,18})(?:/|\.html)?$", 1)
    shown = pages.withColumn("n", number).select("url", F.expr("try_cast(n AS BIGINT)").alias("doc_id"))
    labels = _read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("good"))
    outcomes = shown.join(labels, "doc_id").select("url", "good")
    return url_reputation.judge(pages, outcomes, RULES).select("page_id", "host", "path", "rule", "verdict")


_OP2_SQL = f"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{url_reputation.UPPER}', '{url_reputation.LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
q AS (SELECT *, string_split(host, '.') AS parts, TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})(?:/|\\.html)?$', 1) AS BIGINT) AS doc_id FROM p),
l AS (SELECT doc_id, max(quality) AS good FROM labels GROUP BY doc_id),
h AS (SELECT host, parts, coalesce(sum(good), 0) AS good, CAST(count(good) AS DOUBLE) AS n FROM q LEFT JOIN l USING (doc_id) GROUP BY host, parts),
hd AS (SELECT *, CASE WHEN len(parts) > k THEN array_to_string(parts[-k:], '.') ELSE host END AS suffix,
  CASE WHEN len(parts) > k + 1 THEN array_to_string(parts[-(k + 1):], '.') ELSE host END AS domain
  FROM (SELECT *, CASE WHEN array_to_string(parts[-2:], '.') IN ({", ".join(f"'{x}'" for x in url_reputation.LONG_SUFFIXES)}) THEN 2 ELSE 1 END AS k FROM h)),
d AS (SELECT domain, suffix, sum(good) AS good, sum(n) AS n FROM hd GROUP BY domain, suffix),
s AS (SELECT suffix, sum(good) AS good, sum(n) AS n FROM d GROUP BY suffix),
kids AS (SELECT 'h' AS level, good, n FROM hd UNION ALL SELECT 'd', good, n FROM d UNION ALL SELECT 's', good, n FROM s),
sums AS (SELECT level, CAST(sum(CASE WHEN n > 0 THEN 1 END) AS DOUBLE) AS k, sum(n) AS n, sum(good) AS good, sum(CASE WHEN n > 0 THEN n * (good / n) * (good / n) END) AS sq,
  sum(CASE WHEN n > 0 THEN n * n END) AS nn FROM kids GROUP BY level),
m AS (SELECT *, good / n AS mean, n - nn / n - (k - 1) AS room FROM sums),
w AS (SELECT level, CASE WHEN k > 1 AND good > 0 AND good < n AND room > 0 THEN
  CASE WHEN rho <= 0 THEN {url_reputation.STRONGEST} ELSE least({url_reputation.STRONGEST}, greatest({url_reputation.WEAKEST}, 1 / rho - 1)) END
  ELSE {url_reputation.USUAL} END AS strength
  FROM (SELECT *, (sq - n * mean * mean - mean * (1 - mean) * (k - 1)) / (mean * (1 - mean) * room) AS rho FROM m)),
t AS (SELECT coalesce((sum(good) + 1) / (sum(n) + 2), 0.5) AS top FROM s),
sm AS (SELECT suffix, (good + top * strength) / (n + strength) AS mean FROM s, t, w WHERE level = 's'),
dm AS (SELECT domain, (good + mean * strength) / (n + strength) AS mean FROM d JOIN sm USING (suffix), w WHERE level = 'd'),
ab AS (SELECT host, hd.good + mean * strength AS a, n - hd.good + (1 - mean) * strength AS b FROM hd JOIN dm USING (domain), w WHERE level = 'h'),
low AS (SELECT host, a / (a + b) - {url_reputation.Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS low FROM ab),
r AS (SELECT q.*, low, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM q JOIN low USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN low >= {url_reputation.LEAST} THEN 'allow' ELSE 'block' END AS verdict FROM r
"""


def op3_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bpe_tree.round_trip(_read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, ["doc_id"])
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents"))


def _op4_sql() -> str:
    rows = ", ".join(f"({k}, '{a}', '{b}', {c}, {n}, {license_scan.bounds(n, license_scan.LEAST)[0]}, {license_scan.bounds(n, license_scan.LEAST)[1]}, '{license_scan.TEMPLATES[k].license}')" for k, a, b, c, n in license_scan.template_bigrams())
    return f"""
WITH t(template, word, next, times, t_size, low, high, license) AS (VALUES {rows}),
n AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS row, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g')) AS text FROM documents),
u AS (SELECT doc_id, row, 'line' AS unit, i - 1 AS unit_no, parts[i] AS text FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS parts FROM n))
  UNION ALL SELECT doc_id, row, 'paragraph', i - 1, replace(parts[i], chr(10), ' ')
    FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT *, regexp_split_to_array(text, '\\n\\n+') AS parts FROM n)) WHERE contains(parts[i], chr(10))),
w AS (SELECT doc_id, row, unit, unit_no, string_split(text, ' ') AS words FROM u),
s AS (SELECT *, len(words) - 1 AS size FROM w WHERE len(words) > 1),
b AS (SELECT doc_id, row, unit, unit_no, size, words[i] AS word, words[i + 1] AS next FROM (SELECT *, unnest(range(1, size + 1)) AS i FROM s WHERE size <= (SELECT max(high) FROM t))),
c AS (SELECT doc_id, row, unit, unit_no, size, template, license, t_size, word, next, times, count(*) AS n FROM b JOIN t USING (word, next) WHERE size BETWEEN low AND high GROUP BY ALL),
d AS (SELECT doc_id, row, unit, unit_no, size, template, license, t_size, sum(least(n, times)) AS common FROM c GROUP BY ALL),
e AS (SELECT *, 2.0::DOUBLE * common / (size + t_size) AS dice FROM d),
units AS (SELECT doc_id, row, unit, CAST(unit_no AS INTEGER) AS unit_no, template, license, dice FROM e WHERE dice >= {license_scan.LEAST}
  QUALIFY row_number() OVER (PARTITION BY row, unit, unit_no ORDER BY dice DESC, template) = 1),
sw AS (SELECT doc_id, row, string_split_regex(text, '[ \n]+') AS words FROM n),
sb AS (SELECT doc_id, row, len(words) - 1 AS total, i - 1 AS at, words[i] AS word, words[i + 1] AS next FROM (SELECT *, unnest(range(1, len(words))) AS i FROM sw)),
sm AS (SELECT * FROM sb JOIN t USING (word, next)),
sp AS (SELECT a.doc_id, a.row, a.total, a.template, a.license, a.t_size, a.at AS unit_no, b.word, b.next, b.times, count(*) AS n
  FROM sm a JOIN sm b ON b.row = a.row AND b.template = a.template AND b.at >= a.at AND b.at < a.at + a.t_size GROUP BY ALL),
sd AS (SELECT doc_id, row, template, license, unit_no, least(t_size, total - unit_no) AS size, 2.0::DOUBLE * sum(least(n, times)) / (least(t_size, total - unit_no) + t_size) AS dice FROM sp GROUP BY doc_id, row, template, license, unit_no, t_size, total),
sf AS (SELECT * FROM sd WHERE dice >= {license_scan.LEAST} AND NOT EXISTS (SELECT 1 FROM units u WHERE u.row = sd.row AND u.license = sd.license))
SELECT doc_id, unit, unit_no, template, license, dice FROM units
UNION ALL SELECT doc_id, 'span', CAST(unit_no AS INTEGER), template, license, dice FROM sf s
WHERE NOT EXISTS (SELECT 1 FROM sf o WHERE o.row = s.row AND o.unit_no <= s.unit_no + s.size AND s.unit_no <= o.unit_no + o.size AND (o.dice, -o.template, -o.unit_no) > (s.dice, -s.template, -s.unit_no))
"""


def op5_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_pivot.classes(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_pivot.hex_of().alias("fingerprint"), "component_id")


def op6_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_dac_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "dac")
    dac_tokens.write(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), out)
    return dac_tokens.read(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_language_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_nb.identify(_read(spark, sf_dir, "documents"))


def op9_hnsw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seed.overlaps(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.of_conversations(_read(spark, sf_dir, "conversations"), prefix_trie.GROUP)


def op12_order_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_spelling_kd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.count_words(_read(spark, sf_dir, "documents"), drop_every=97))


QUERIES: dict[str, Query] = {
    "op1_warc_store": op1_warc_store,
    "op2_url_reputation": op2_url_reputation,
    "op3_bpe_tree": op3_bpe_tree,
    "op4_license_scan": op4_license_scan,
    "op5_simhash_pivots": op5_simhash_pivots,
    "op6_attention_mil": op6_attention_mil,
    "op7_dac_tokens": op7_dac_tokens,
    "op8_language_nb": op8_language_nb,
    "op9_hnsw_dedup": op9_hnsw_dedup,
    "op10_spaced_seeds": op10_spaced_seeds,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_order_packing": op12_order_packing,
    "op13_spelling_kd": op13_spelling_kd,
}
SQL: dict[str, str] = {"op1_warc_store": _OP1_SQL, "op2_url_reputation": _OP2_SQL, "op4_license_scan": _op4_sql()}
