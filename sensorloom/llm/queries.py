"""Queries of the document operators, each over its whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm import alignment, bpe, collocations, decontam, licenses, line_dedup, media, ngram_join, pii, sql, substring, token_store, toxicity, url_lists
from sensorloom.session import bounded_batches, table, written


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontam.digest(found)


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """The production model: learns from labelled rows that aren't held out."""
    return toxicity.fit(docs, labels, train=~toxicity.held_out(F.col("doc_id")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def tokenizer_file(name: str) -> str:
    """A file of the installed public tokenizers; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_store.new_store(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), out, tokenizer_file("byte_bpe_50k.json"))
    return token_store.read_tokens(spark, out, arrays=False)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are the pages, dated by their id. Entries come from the events: a user's page gives the domain (for every
    third event its parent domain), the event's time the date, its type the list, its value whether it is listed."""
    pages, events = table(spark, sf_dir, "pages"), table(spark, sf_dir, "events")
    second = F.expr("make_dt_interval(0, 0, 0, cast(page_id * 7919 % 2592000 as decimal(18,6)))")
    captures = pages.select("page_id", "url", (F.expr("timestamp_ntz'2024-01-01 00:00:00'") + second).alias("fetched_at"))
    hosts = pages.select(F.col("page_id").alias("user_id"), url_lists.host_of(F.col("url")).alias("host"))
    parent = F.regexp_replace("host", r"^[^.]+\.", "")
    entries = events.join(hosts, "user_id").select(
        F.col("event_type").alias("list"),
        F.when(F.col("event_id") % 3 == 0, parent).otherwise(F.col("host")).alias("domain"),
        F.col("ts").cast("timestamp_ntz").alias("listed_at"),
        (F.floor("value") % 4 != 0).alias("listed"),
    )
    return url_lists.listed_captures(captures, entries).withColumn("blocked", F.col("n_active") > 0)


OP5_SQL = """
WITH hosts AS (
  SELECT page_id, timestamp '2024-01-01' + to_seconds(page_id * 7919 % 2592000) AS fetched_at,
         rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.') AS h
  FROM pages),
shots AS (SELECT page_id, fetched_at, CASE WHEN h <> '' AND length(h) <= 253 THEN h END AS host FROM hosts),
entries AS (
  SELECT e.event_type AS list, CASE WHEN e.event_id % 3 = 0 THEN regexp_replace(s.host, '^[^.]+\\.', '') ELSE s.host END AS domain,
         e.ts AS listed_at, bool_or(floor(e.value)::BIGINT % 4 <> 0) AS listed
  FROM events e JOIN shots s ON e.user_id = s.page_id
  WHERE e.event_type IS NOT NULL AND s.host IS NOT NULL AND e.ts IS NOT NULL AND e.value IS NOT NULL
  GROUP BY 1, 2, 3),
valid AS (
  SELECT list, domain, listed, listed_at AS from_ts, lead(listed_at) OVER (PARTITION BY list, domain ORDER BY listed_at) AS until_ts
  FROM entries),
own AS (
  SELECT page_id, host, fetched_at, unnest(list_transform(range(1, len(string_split(host, '.')) + 1),
         lambda k: array_to_string(string_split(host, '.')[k:], '.'))) AS domain
  FROM shots WHERE host IS NOT NULL),
met AS (
  SELECT o.page_id, count(*) AS n, string_agg(DISTINCT v.list, ',' ORDER BY v.list) AS lists
  FROM own o JOIN valid v ON o.domain = v.domain AND v.listed AND o.fetched_at >= v.from_ts AND (v.until_ts IS NULL OR o.fetched_at < v.until_ts)
  GROUP BY 1)
SELECT s.page_id, s.host, coalesce(m.n, 0) AS n_active, coalesce(m.lists, '') AS lists, coalesce(m.n, 0) > 0 AS blocked
FROM shots s LEFT JOIN met m USING (page_id)
"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.drop_repeated_lines(docs, counts=("n_lines", "n_removed"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(media.encode_media(table(spark, sf_dir, "documents")), "media")
    return media.media_features(stored, arrays=False)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan_licenses(table(spark, sf_dir, "documents")))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.digest(substring.find_repeats(docs, kept=True))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top_phrases(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_token_store": op3_token_store,
    "op4_ngram_join": op4_ngram_join,
    "op5_url_lists": op5_url_lists,
    "op6_line_dedup": op6_line_dedup,
    "op7_pii": op7_pii,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_media": op9_media,
    "op10_licenses": op10_licenses,
    "op11_alignment": op11_alignment,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_collocations": op13_collocations,
}
ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": sql.DECONTAMINATION,
    "op4_ngram_join": sql.NGRAM_JOIN,
    "op5_url_lists": OP5_SQL,
    "op6_line_dedup": sql.LINE_DEDUP,
    "op7_pii": sql.PII,
    "op12_substring_dedup": sql.SUBSTRING_DEDUP,
    "op13_collocations": sql.COLLOCATIONS,
}
