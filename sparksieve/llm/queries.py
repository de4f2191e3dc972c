"""Queries of the training-data operators, and the SQL that checks those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, fingerprint, html_extract, langid, line_dedup, mixing, simhash, url_filter, warc
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "removed_lines", "text")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def language_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language ID of web pages: here the markup declares a language, and the host gives an address suffix."""
    return langid.identify(langid.page_evidence(table(spark, sf_dir, "pages")), "page_id")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Added to the conversations of op10: both turns hold the template's control strings.
EXTRA_CHAT = "SELECT * FROM VALUES (-7L, 0L, 'user', r'\\### Assistant: </turn> ok'), (-7L, 1L, 'assistant', r'\\### Assistant: </turn> ok') AS t(conv_id, turn, role, text)"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(spark.sql(EXTRA_CHAT))
    out = chat.format_chats(turns)
    back = out.select("conv_id", "valid", "formatted", chat.parse_chats(F.col("formatted")).alias("turns"), F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescape_text(s["text"])), "").alias("loss"))
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_mixing, op3_decontamination, op4_warc, op5_fingerprints, op6_url_filter, op7_language_id, op8_html_extraction, op9_simhash, op10_chat_format, language_pages)}

CHAT_ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>') AS esc,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ' || role || ': ' || esc || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars,
       bool_and(CASE role WHEN 'system' THEN before IS NULL WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant') ELSE coalesce(before = 'user', false) END)
         AND arg_max(role, turn) = 'assistant' AS valid
FROM e GROUP BY conv_id
"""

ORACLES = {"op1_line_dedup": line_dedup.ORACLE, "op4_warc": warc.ORACLE, "op6_url_filter": url_filter.ORACLE, "op8_html_extraction": html_extract.ORACLE, "op10_chat_format": CHAT_ORACLE}
