"""From raw documents to packed training sequences.

STAGES are run in order; each works on all that its predecessor kept, and its decisions
take effect. Every stage's result is a Parquet table in the shared folder, so a lost
executor costs no more than the stage at hand.

1. quality_rules: rows that fail the base test or that a learned rule rejects go. The rules are
   learned from the labels of the documents at hand.
2. language_id: rows without letters (`und`) and rows whose language is not sure (score below
   `LEAST_SURE`) go.
3. near_duplicates: of each group linked by five-word shingles at a Jaccard similarity of 0.8
   or more, the document with the smallest doc_id stays, once. Texts without words link with nothing
   but rows of the same doc_id without words. Different texts that share a doc_id are different documents.
4. decontamination: rows with a window that leaks a benchmark item go.
5. packing: what is left becomes pieces of sequences of 1024 tokens, with their places.

All stages but the last return the columns of documents, unchanged. Null texts have no
words and go in the first stage; rows without doc_id link with nothing and stay; an empty table
stays empty; a table may have any further columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquet.llm import decontaminate, jaccard_join, language_id, packing, quality_rules
from barquet.llm.common import checked_broadcast, importable, table
from barquet.llm.queries import tokenizer_path
from barquet.session import materialize

# A score is the product of the winners' probabilities in two duels, each at least a half but for
# cycles: a bound of a quarter or less never holds anything back.
LEAST_SURE = 0.65


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is not among a stored table's."""
    return docs.join(checked_broadcast(ids), docs["doc_id"].eqNullSafe(ids["id"]), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.accepted(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return language_id.confident(docs, language_id.train(docs), LEAST_SURE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    with_id = docs.filter("doc_id is not null")
    if with_id.groupBy("doc_id").count().filter("count > 1").isEmpty():
        found = materialize(jaccard_join.join(docs, size=5, num=80, den=100), "groups")
        copies = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
        return _without(docs, materialize(copies, "copies"))
    # Where doc_ids repeat, rows are told apart by a number of their own.
    row = "row_number"
    while row in docs.columns:
        row += "_"
    rows = materialize(docs.withColumn(row, F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "rows")
    found = jaccard_join.join(rows.select(F.col(row).alias("doc_id"), "text"), size=5, num=80, den=100)
    found = materialize(
        found.filter("doc_id is not null").select(F.col("doc_id").alias("id"), F.col("component_id").alias("of"), F.col("n_shingles").alias("n")), "groups"
    )
    ids = rows.select(F.col(row).alias("id"), "doc_id")
    found = found.join(ids, "id").withColumn("empty_of", F.when(F.col("n") == 0, F.col("doc_id"))).withColumn(
        "of", F.when(F.col("n") > 0, F.col("of"))
    )
    kept = materialize(
        found.groupBy("of", "empty_of").agg(F.min(F.struct("doc_id", "id")).alias("z")).select("z.id"), "kept"
    )
    copies = materialize(found.select("id").join(checked_broadcast(kept), "id", "left_anti"), "copies")
    return rows.join(checked_broadcast(copies), rows[row] == copies["id"], "left_anti").drop(row)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality),
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

# Learned rules, language models and tokens are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
