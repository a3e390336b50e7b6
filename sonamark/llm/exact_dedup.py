"""Exact dedup: tree merge of sorted digest runs, in DataFrame operations only.

Every row gets a run number, that of its partition. Level 0 reduces each run, within its partition, to one entry for each digest. Then runs meet in
rounds, as in a binomial tree but `fan_in` at a time: round k brings the runs together whose numbers agree after division by fan_in**k, sorts
their entries by digest, and merges neighbours of one digest. A run is cut into segments by the leading bits of the digest, and segments are merged by
tasks of their own, so the last round has as many tasks as the first. A merged entry keeps the identifier that stays and the number of
rows behind it. Entries merge only where they agree in SHA-256 and, as a check on it, in byte length and xxhash64. A text with millions of
copies is `fan_in` entries in a round at most: no group of copies is ever gathered in one task. When rows meet their groups
again, digests of many rows are salted.

Nulls: a null text counts as empty. A null id stays only where its group has no other id; it then stands for the group.
Repeated rows (same id, same text) count in group_size and share `kept`. Very long texts are only hashed. Empty tables give empty results. Input columns
other than the two named are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, fresh, lower_ascii, row_hash, split_join, written

KEY = ["sha", "n_bytes", "xx"]


def digests(docs: DataFrame, best: Column, text: Column) -> DataFrame:
    """(best, sha, n_bytes, xx) of the normalised text of each row; best orders the rows of a group."""
    norm = docs.select(best.alias("best"), lower_ascii(F.coalesce(text, F.lit(""))).alias("t"))
    return norm.select("best", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("sha"), F.octet_length("t").alias("n_bytes"), F.xxhash64("t").alias("xx"))


def merge_runs(rows: DataFrame, runs: int, segments: int, fan_in: int = 8, keep: str = "max") -> DataFrame:
    """rows (best, KEY) -> one row (KEY, best, group_size) for each distinct text, merged level by level."""
    segment = F.shiftright(F.conv(F.hex(F.substring("sha", 1, 4)), 16, 10).cast("long") * segments, 32).cast("int")
    level = rows.withColumn("run", F.pmod(F.spark_partition_id(), F.lit(runs))).groupBy("run", *KEY).agg((F.max if keep == "max" else F.min)("best").alias("best"), F.count("*").alias("group_size"))
    level = level.withColumn("segment", segment)
    while runs > 1:
        runs = -(-runs // fan_in)
        level = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).repartition(segments, "run", "segment")
        same = W.partitionBy("run", "segment", *KEY)
        first = F.row_number().over(same.orderBy(F.desc_nulls_last("best") if keep == "max" else F.asc_nulls_last("best")))
        level = level.sortWithinPartitions("run", "segment", *KEY).withColumns({"first": first, "group_size": F.sum("group_size").over(same)}).where("first = 1").drop("first")
    return level.drop("run", "segment")


def grouped(rows: DataFrame, fan_in: int = 8, keep: str = "max") -> DataFrame:
    """merge_runs of written rows; the table is written."""
    partitions = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return written(merge_runs(rows, max(2, min(fan_in**2, partitions)), partitions, fan_in, keep), "merged")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", fan_in: int = 8) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (of the text with A-Z lower-cased)."""
    rows = written(digests(docs, F.col(id_col), F.col(text_col)).withColumnRenamed("best", "id"), "digests")
    merged = grouped(rows.withColumnRenamed("id", "best"), fan_in, keep).select("sha", F.col("n_bytes").alias("nb"), F.col("xx").alias("x"), F.col("best").alias("keep_id"), "group_size")
    out = split_join(rows, merged, "sha", "id", sizes=merged.select("sha", F.col("group_size").alias("_n"))).where((F.col("nb") == F.col("n_bytes")) & (F.col("x") == F.col("xx")))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.coalesce(F.col("id").eqNullSafe(F.col("keep_id")), F.lit(False)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact(docs: DataFrame, keep: str = "max", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, its columns unchanged: the one with the largest id (a null id only where there is no other).
    Of rows that repeat both, the one with the largest hash of all columns stays, so runs agree; of rows that are equal throughout, one. Rows are told apart by
    digest, id and that hash, in columns whose names no column of docs has; texts are shuffled once, and by no hot key."""
    sha, best = fresh(docs, "sha"), fresh(docs, "best")
    order = F.col(id_col) if keep == "max" else -F.col(id_col)
    which = F.struct(F.col(id_col).isNotNull().alias("has_id"), F.coalesce(order, F.lit(0)).alias("id"), row_hash(docs).alias("whole"))
    own = written(digests(docs, which, F.col(text_col)), "digests")
    stay = grouped(own).select(F.col("sha").alias(sha), F.col("best").alias(best))
    discard(own)
    rows = docs.withColumns({sha: F.unhex(F.sha2(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256)), best: which})
    return rows.join(stay, [sha, best], "left_semi").dropDuplicates([sha, best]).select(*(F.col(f"`{c}`") for c in docs.columns))
