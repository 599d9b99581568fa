"""The registered text queries: DuckDB statements, and held-out accuracy of the models."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from barquet.llm import queries
from verification.check import compare, connect

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(queries.ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    problem, count = compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name])
    assert problem is None and count > 0


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.QUERIES["op3_language_id"](spark, SF).join(docs, "doc_id").filter("held_out")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.95


def test_quality_of_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    got = queries.QUERIES["op10_compression"](spark, SF).join(labels, "doc_id").filter("held_out")
    right = got.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0]
    assert right > 0.85
