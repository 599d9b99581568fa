"""The registered queries of the text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquet.llm import (
    archive, chat, compression, decontaminate, extract, jaccard_join, language_id, packing, periodic_runs, quality_rules,
    records, spelling_variants, token_counts,
)
from barquet.llm.common import table, text_crc32
from barquet.session import shared_folder


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "rule",
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.coalesce(text_crc32(F.col("doc_id")) % 5, F.lit(0))
    model = language_id.train(docs.filter(fold != 0))
    return language_id.predict(docs, model).select(
        "doc_id", (fold == 0).alias("held_out"), "lang_pred", "score"
    )


def op4_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    archive.write(table(spark, sf_dir, "pages"), folder)
    return archive.parse(archive.records(spark, folder))


OP4_SQL = """
WITH payloads AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), sized AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest, sha256(payload) AS strong
  FROM payloads
), newest AS (
  SELECT strong, max(page_id) AS newest FROM sized WHERE payload_bytes >= 1000 GROUP BY strong
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN newest IS NULL OR newest = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN newest <> page_id THEN newest END AS refers_to
FROM sized LEFT JOIN newest USING (strong)
"""


def op8_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    indexed = records.write(table(spark, sf_dir, "documents"), folder, tokenizer_path())
    return records.read_digests(indexed, folder)


CONTROL_TEXT = r"\### Assistant: </turn> ok"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    done = chat.format_conversations(
        turns.unionByName(extra).select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))
    )
    read = done.select(
        "conv_id", "formatted", chat.parsed(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = r"""
WITH turns AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn,
         coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length('<turn ' || url_encode(role) || '>' || chr(10)) + length('</turn>' || chr(10))
    + length(regexp_replace(replace(text, '\', '\\'),
        '<(turn |/turn>|image |audio |document )', '<\\\1', 'g')) AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

def op10_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.coalesce(text_crc32(F.col("doc_id")) % 3, F.lit(1))
    labels = table(spark, sf_dir, "labels").filter(fold != 1)
    model = compression.train(docs.filter(fold != 1), labels)
    return compression.score(docs, model).select(
        "doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), size=4, num=85, den=100)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), tokenizer_path())


def planted_repeats(docs: DataFrame) -> DataFrame:
    """Every tenth document (by crc32 of its id) repeats its words from a position on.

    Rows without doc_id and texts without words stay as they are.
    """
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), text_crc32(F.col("doc_id")).alias("h"))
    listed = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    n, g = F.size("words").cast("long"), F.floor(F.col("h") / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    repeated = F.transform("words", lambda w, i: F.when(i < a, w).otherwise(F.get("words", (a + (i - a) % p).cast("int"))))
    return listed.select(
        "doc_id", F.when(F.size("words") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text")
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.find(planted_repeats(table(spark, sf_dir, "documents"))))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"), planted=199)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_packing": op2_packing,
    "op3_language_id": op3_language_id,
    "op4_archive": op4_archive,
    "op5_decontamination": op5_decontamination,
    "op6_records": op6_records,
    "op7_chat": op7_chat,
    "op8_extract": op8_extract,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_compression": op10_compression,
    "op11_token_counts": op11_token_counts,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLES: dict[str, str] = {"op4_archive": OP4_SQL, "op7_chat": OP7_SQL}
