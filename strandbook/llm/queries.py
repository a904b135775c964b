"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, near_duplicates, neighbours, personal_data, piece_codec, quality_rules, shards, token_counts, url_filters, warc_derivatives
from .common import Scratch

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.jaccard_components(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op9_mixing_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find(table(spark, sf_dir, "documents")).drop("row_key", "found")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trip(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


ARRIVALS = 16


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that arrive in ARRIVALS runs, compacted, and read again through the last manifest."""
    docs = table(spark, sf_dir, "documents")
    store = shards.ShardStore(spark, Scratch(spark).root)
    store.append_each(docs, F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)))
    store.compact(docs.schema)
    rows = store.read(docs.schema)
    return rows.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_derivatives.derive(warc_derivatives.responses_of(table(spark, sf_dir, "pages")))
    return records.select("page_id", "type", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest", "n_bytes", F.sha2("record", 256).alias("record_sha256"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op5_warc_derivatives": op5_warc_derivatives,
    "op6_url_filters": op6_url_filters,
    "op3_sentencepiece": op3_sentencepiece,
    "op8_token_counts": op8_token_counts,
    "op9_mixing_to_weights": op9_mixing_to_weights,
    "op10_pii": op10_pii,
    "op4_quality_rules": op4_quality_rules,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
}


def _url_filters_sql() -> str:
    """Rules and globs as plain comparisons: the longest rule that fits, else any glob as a LIKE pattern."""
    fits = []
    for verdict, rule in sorted(url_filters.RULES, key=lambda r: -len(r[1])):
        host, _, rest = rule.partition("/")
        fits.append((f"(host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '/{rest}')", rule, verdict))
    like = " OR ".join("canon LIKE '" + g.replace("_", "\\_").replace("*", "%") + "%' ESCAPE '\\'" for _, g in url_filters.GLOBS)
    rules = " ".join(f"WHEN {test} THEN '{rule}'" for test, rule, _ in fits)
    verdicts = " ".join(f"WHEN {test} THEN '{verdict}'" for test, _, verdict in fits)
    return f"""WITH cut AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{url_filters.UPPER}', '{url_filters.LOWER}') AS host,
      regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages), told AS (SELECT *, '.' || host || chr(0) || path AS canon FROM cut)
    SELECT page_id, host, path, CASE {rules} END AS rule, CASE {verdicts} WHEN {like} THEN 'block' ELSE '{url_filters.DEFAULT}' END AS verdict FROM told"""


ORACLES: dict[str, str] = {"op1_sharding": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents", "op6_url_filters": _url_filters_sql()}
