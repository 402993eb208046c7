"""The registered queries of this subpackage, each over a whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import run_folder
from .alignment import align_tokenizers
from .bpe import bpe_round_trip
from .common import read_table
from .embeddings import embedding_components
from .filter_audit import filter_interactions
from .mixing import mix_sources
from .ngram import score_texts
from .quality import quality_rules
from .secrets import scan
from .sharding import shard_documents
from .simhash import simhash_components
from .transducer import transducer_round_trip
from .url_filter import filter_urls
from .warc import page_number, payload_digest, read_warc, write_warc

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
SHARDS = 24
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(read_table(spark, sf_dir, "embeddings"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_folder(spark, "warc")
    write_warc(read_table(spark, sf_dir, "pages"), folder)
    return (
        read_warc(spark, folder)
        .withColumn("revisit", F.col("record_type") == "revisit")
        .select(
            page_number(F.col("record_id")).alias("page_id"),
            # a revisit has no payload of its own
            F.when(F.col("revisit"), F.col("payload_length")).otherwise(F.length("payload")).cast("long").alias("payload_bytes"),
            F.when(F.col("revisit"), F.substring_index("payload_digest", ":", -1))
            .otherwise(payload_digest(F.col("payload")))
            .alias("payload_digest"),
            "record_type",
            page_number(F.col("refers_to")).alias("refers_to"),
        )
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(read_table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_interactions(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    return transducer_round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    return align_tokenizers(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))[0]


def queries() -> dict[str, Query]:
    every = [
        op1_url_filter, op2_embedding_dedup, op3_mix_sources, op4_lm_scores, op5_bpe, op6_warc, op7_secret_scan, op8_quality,
        op9_shards, op10_simhash, op11_filter_audit, op12_bpe_transducer, op13_tokenizer_alignment,
    ]
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return {
        "op1_url_filter": rf"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
         row_number() OVER () AS n
  FROM pages),
rules(rule_host, rule_path, rule_verdict) AS (VALUES {rules}),
fitting AS (
  SELECT p.*, r.*, row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
  FROM parts p LEFT JOIN rules r
    ON ('.' || p.host LIKE '%.' || r.rule_host) AND starts_with(p.path, r.rule_path))
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(rule_verdict, 'allow') AS verdict
FROM fitting WHERE place = 1""",
        "op3_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) + 1] AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, row_number() OVER w AS place,
         (CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM sources WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST)),
chosen AS (SELECT arg_min(level, place) AS level FROM levels WHERE level * weight <= 3 * source_size),
targets AS (
  SELECT l.source, source_size, least(c.level * weight, CAST(3 * source_size AS DOUBLE)) AS target
  FROM levels l, chosen c),
placed AS (
  SELECT s.*, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
         coalesce(CAST(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE CAST(
         (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) AS BIGINT) END AS taken
FROM placed""",
        "op6_warc": """
WITH digests AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
coded AS (
  SELECT page_id, payload_bytes, array_to_string([array_to_string(
           [substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(hex, 5 * k + 1, 5) AS INTEGER) >> s) & 31) + 1, 1) FOR s IN [15, 10, 5, 0]],
           '') FOR k IN range(8)], '') AS payload_digest
  FROM digests),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS original FROM coded)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS DISTINCT FROM original AND original IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM firsts""",
        "op11_filter_audit": r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents),
flags AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masked AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         concat(CASE WHEN len(words) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' END,
                CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' END,
                CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END, CASE WHEN t.doc_id > least THEN 'E' END) AS failing
  FROM texts t LEFT JOIN flags f ON t.doc_id = f.doc_id),
cells AS (SELECT part, failing, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM masked GROUP BY ALL),
letters(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT concat(a.f, b.f, c.f, d.f, e.f) AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, CAST(step AS INT) AS step, filter_order[step] AS own, filter_order[1:step - 1] AS earlier
          FROM orders, range(1, 6) r(step)),
met AS (
  SELECT part, filter_order, step, own, n, n_good, n_toxic, contains(failing, own) AS fails, failing = own AS alone,
         len(regexp_extract_all(failing, '[' || earlier || ' ]')) = 0 AS here
  FROM cells, steps),
counted AS (
  SELECT part, filter_order, step, own,
         CAST(coalesce(sum(n) FILTER (here AND NOT fails), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (here AND fails), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (NOT here AND fails), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (alone), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(n_good) FILTER (here AND fails), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(n_toxic) FILTER (here AND fails), 0) AS BIGINT) AS toxic_lost
  FROM met GROUP BY ALL)
SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM counted""",
    }
