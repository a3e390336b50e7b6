"""An id that half of the rows share is no task of its own, and its rows still follow one another."""

from collections import Counter

from pyspark.sql import functions as F

from sonamark.llm import prefix_hash


def test_rows_of_one_id_are_dealt_out(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    beside = prefix_hash.beside_next(rows, "doc_id", "text").withColumn("p", F.spark_partition_id())
    sizes = [r["count"] for r in beside.where("extra = 0").groupBy("p").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1.5 * 4000 / len(sizes) and len(sizes) > 1
    assert beside.where("extra = 1").count() == len(sizes)
    out = [(r.doc_id, r.n_chars) for r in prefix_hash.fingerprint_documents(rows).collect()]
    assert Counter(out) == Counter((i if i % 2 == 0 else None, len(f"text {i}")) for i in range(4000))


def test_equal_rows(spark):
    rows = spark.createDataFrame([(None, "same")] * 50 + [(7, "same")] * 50, "doc_id long, text string")
    out = prefix_hash.fingerprint_documents(rows).collect()
    assert len(out) == 100 and all(r.near_next == 1.0 for r in out)
