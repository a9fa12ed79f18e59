"""Columns that hold maps, which Spark can't hash, beside the texts."""

import pytest
from pyspark.sql import functions as F

from clausemill.llm.decontaminate import drop_leaks
from clausemill.llm.licenses import scan_licenses
from clausemill.llm.secrets import scan_secrets
from clausemill.llm.sharding import shard_documents

TEXTS = ["under the mit license", "password = b7db7aa4a5fcc78305", None, "", "a passage of the benchmark that is long enough to be found again", "under the mit license"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("doc_id", F.when(F.col("doc_id") < 5, F.col("doc_id")).otherwise(0))
    return df.withColumns({"meta": F.when(F.col("doc_id") != 2, F.create_map(F.lit("k"), "text")), "nested": F.array(F.struct(F.create_map("doc_id", F.lit(1)).alias("m")))})


def test_operators_keep_maps(docs):
    bench = docs.where("doc_id = 4").select(F.lit(1).cast("long").alias("item_id"), "text")
    shards = shard_documents(docs, byte_limit=30)
    assert shards.count() == 6 and dict(shards.dtypes)["meta"] == "map<string,string>"
    assert sorted(r.doc_id for r in scan_licenses(docs).where("base_labels = 'mit'").collect()) == [0, 0]
    assert [r.doc_id for r in scan_secrets(docs).where(F.size("secrets") > 0).collect()] == [1]
    left = drop_leaks(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [0, 0, 1, 2, 3]
