"""Small helpers shared by the text operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def scratch(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: spark.checkpoint.dir, or a new local one where that is unset (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: cuts the lineage, and a lost executor costs nothing. The shuffle files of the write, which
    nothing reads again, go at its end."""
    path, spark = fresh_path(df.sparkSession, name), df.sparkSession
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting of the session for the time of a block."""
    was = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of written tables that nothing reads any more; other tables are left alone."""
    for table in tables:
        if folder := vars(table).get("folder"):
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def arrow_rows(spark: SparkSession, rows: int = 512) -> None:
    """Bounds the rows of an Arrow batch; a text may be long, so the default of 10,000 rows is too many."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def lower_ascii(col: Column) -> Column:
    """A-Z only. lower() does the same, faster, where every character is one byte."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def crc_mod(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the folds that hold documents out. A null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased, as UTF-8: bytes.lower and bytes.split know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def most_frequent(counts: DataFrame, count: str, limit: int) -> DataFrame:
    """At most limit rows: those with the highest counts, as many whole steps of an eighth of a doubling as fit. The steps are counted first (a few
    hundred rows), so no task sends more rows to the driver than the result has."""
    step = F.floor(F.log2(F.col(count)) * 8)
    sizes = counts.where(F.col(count) > 0).groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()
    least, total = None, 0
    for r in sorted(sizes, reverse=True):
        total += r.n
        if total > limit:
            break
        least = r.step
    return counts.where((F.col(count) > 0) & (step >= least)) if least is not None else counts.where(F.lit(False))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


#: Keys with more than this share of the rows of a join are split, so at most so many are.
PIECES = 2000


def split_join(rows: DataFrame, table: DataFrame, key: str, by: str, like: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """rows joined with table, which has one row for each key. A key that many rows share is split by a hash of column `by` over as many
    tasks as it has 1/PIECES of the rows; its row of the table goes to each. Split are fewer than PIECES keys, so their list is broadcast, and the
    table gets fewer than 2 * PIECES rows more. Keys are counted in `like` (rows with the same keys, less wide), else in rows, or come with
    their counts as `sizes` (key, _n); pass written tables."""
    keys = like if like is not None else rows
    share = F.col("_n") * PIECES / F.lit(max(1, keys.count()))
    sizes = keys.groupBy(key).agg(F.count("*").alias("_n")) if sizes is None else sizes
    hot = sizes.where((F.col("_n") > 1000) & (share > 1) & F.col(key).isNotNull()).select(key, F.ceil(share).cast("int").alias("_parts"))
    part = F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"), F.lit(0))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_part", part).drop("_parts")
    right = table.join(F.broadcast(hot), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts") - 1, F.lit(0))))).drop("_parts")
    return left.join(right, [key, "_part"]).drop("_part")


def row_hash(df: DataFrame, *salt: int) -> Column:
    """A hash of all columns of a row; columns of arrays, structs and maps by their JSON, since maps have no hash."""
    nested = (T.MapType, T.ArrayType, T.StructType)
    one = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`"))) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")
    return F.xxhash64(*map(F.lit, salt), *map(one, df.schema.fields))
