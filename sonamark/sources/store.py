"""Stored tables: years in partitions, exports, the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import read_files

VIEWS = {"v_measurement", "v_run", "v_shot"}


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, which executors share; a local one where that is unset (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return f"{(root or 'file://' + tempfile.mkdtemp(prefix='spark-', dir='/tmp')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: its lineage is cut, and a lost executor costs nothing."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_unmatched(runs: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """runs, and published rows that have none, marked in_summary."""
    return runs.withColumn("in_summary", F.lit(False)).unionByName(rows.join(runs.select(key), key, "left_anti").withColumn("in_summary", F.lit(True)), allowMissingColumns=True)


def export(df: DataFrame, view: str, path: str) -> None:
    """Writes a view as CSV, JSON lines or Parquet, by the path's ending."""
    if view not in VIEWS:
        raise ValueError(f"no view {view}")
    kind = path.rsplit(".", 1)[-1]
    {"csv": lambda w: w.option("header", True).csv(path), "json": lambda w: w.json(path), "jsonl": lambda w: w.json(path), "parquet": lambda w: w.parquet(path)}[kind](df.write)


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of every file below a path. Files of any size are streamed; none is a value."""
    files = read_files(spark, path, "path string, bytes long, sha256 string")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "sha256")


def version(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: 12 hex digits that depend on the rows, not on their order or partitions. Hashes are summed in each task first."""
    h = F.xxhash64(*columns)
    sums = df.agg(F.count("*").alias("n"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("a"), F.sum(F.shiftrightunsigned(h, 33)).alias("b"), F.bit_xor(h).alias("x"))
    return sums.select(F.substring(F.sha2(F.concat_ws("-", "n", "a", "b", "x").cast("binary"), 256), 1, 12).alias("version"))


def sample_rows(records: DataFrame, run: str, samples: str, t0: float, dt: float) -> DataFrame:
    return records.select(run, F.posexplode(samples).alias("i", "pressure_pa")).select(run, (F.lit(t0) + F.col("i") * dt).alias("time_s"), F.col("pressure_pa").cast("double").alias("pressure_pa"))


def sample_arrays(records: DataFrame, run: str, samples: str, t0: Column | float, dt: Column | float) -> DataFrame:
    """(run, time_s, pressure_pa): the times of a record's samples and the samples, as two arrays of one length."""
    t0, dt = (F.lit(x) if isinstance(x, float) else x for x in (t0, dt))
    return records.select(run, F.transform(samples, lambda x, i: t0 + i * dt).alias("time_s"), F.transform(samples, lambda x: x.cast("double")).alias("pressure_pa"))


def spectra_json(spectrum: Column) -> Column:
    """Levels to a tenth of a decibel, NaN as null, as JSON."""
    return F.to_json(F.transform(spectrum, lambda x: F.when(~F.isnan(x), F.round(x, 1))))


def spectra_of_runs(rows: DataFrame, run: str, mic: str, spectrum: str) -> DataFrame:
    """(run, spectra): for each run one JSON object, microphone -> levels to a tenth of a decibel, NaN as null. A run has a few microphones."""
    levels = F.transform(F.col(spectrum), lambda x: F.when(~F.isnan(x), F.round(x, 1)))
    return rows.where(F.col(mic).isNotNull()).groupBy(run).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(mic), levels))))).alias("spectra"))


def publish(df: DataFrame, folder: str, name: str, columns: list[str]) -> str:
    """Writes a table under its content's version, which is returned: the same rows have the same folder, whatever their order, and are not written twice."""
    found = version(df, columns).first()[0]
    df.write.mode("overwrite").parquet(f"{folder}/{name}-{found}")
    return found
