"""Text exports of recordings, spec files and the published summary, parsed by column expressions."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.levels import METRICS
from ..functions.names import spec_note
from .files import read_files

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Rows of `Undefined` at the end that make a capture short rather than damaged.
SHORT_TAIL = 64


def number(x: Column) -> Column:
    """The number in a string; null for anything else, such as 1d, that a cast would take."""
    return F.when(F.trim(x).rlike(NUMBER), F.trim(x).try_cast("double"))


def key_values(lines: Column) -> Column:
    """Map of `Key: ... value` lines: the last field between tabs that isn't blank. Markers that end in Begin or End are left out; a later key wins."""
    pair = F.transform(
        F.filter(lines, lambda x: x.contains(":") & ~x.rlike(r"^[^:]*(Begin|End):")),
        lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.element_at(F.concat(F.array(F.lit("")), F.filter(F.transform(F.split(F.regexp_replace(x, "^[^:]*:", ""), "\t"), lambda v: F.trim(v)), lambda v: v != "")), -1).alias("v")),
    )
    keys = F.array_distinct(F.transform(pair, lambda p: p.k))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pair, lambda p: p.k == k), -1).v))


def parse_captures(files: DataFrame, path: str = "path", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row for each export: path, columns to keep, header, tags, samples, defects, dropped_tail, flags and typed header fields."""
    lines = F.split(F.regexp_replace(F.col(text), "\r", ""), "\n")
    keep = keep or []
    x = files.select(path, *keep, lines.alias("lines")).withColumn("is_data", F.transform("lines", lambda v: v.rlike(r"^\s*\d+\t")))
    x = x.withColumn("first", F.array_position("is_data", True).cast("int"))
    x = x.withColumns({"data": F.filter("lines", lambda v: v.rlike(r"^\s*\d+\t")), "head": F.when(F.col("first") > 0, F.slice("lines", F.lit(1), F.col("first") - 1)).otherwise(F.col("lines"))})
    x = x.withColumn("foot", F.when(F.col("first") > 0, F.filter(F.slice("lines", F.col("first"), F.size("lines")), lambda v: ~v.rlike(r"^\s*\d+\t"))).otherwise(F.array().cast("array<string>")))
    x = x.withColumn("tokens", F.transform("data", lambda v: F.trim(F.element_at(F.split(v, "\t"), -1))))
    last = F.coalesce(F.array_max(F.transform("tokens", lambda t, i: F.when(t != "Undefined", i + 1))), F.lit(0))
    x = x.withColumn("tail", F.size("tokens") - last).withColumn("dropped_tail", F.when(F.col("tail") >= SHORT_TAIL, F.col("tail")).otherwise(0))
    x = x.withColumn("kept", F.slice("tokens", F.lit(1), F.size("tokens") - F.col("dropped_tail")))
    x = x.withColumns({"header": key_values(F.col("head")), "tags": key_values(F.col("foot"))})
    h = lambda k: F.element_at("header", k)
    dt, rate = number(h("X-Axis delta")), number(h("InputSampleFrequency"))
    return x.select(
        path,
        *keep,
        "header",
        "tags",
        F.transform("kept", lambda t: F.coalesce(number(t), F.lit(float("nan"))).cast("float")).alias("samples"),
        F.filter(F.transform("kept", lambda t, i: F.when(~t.rlike(NUMBER), F.struct(i.alias("idx"), t.alias("raw")))), lambda d: d.isNotNull()).alias("defects"),
        "dropped_tail",
        (F.size("tokens") < number(h("X-Axis size"))).alias("truncated"),
        (F.col("dropped_tail") > 0).alias("short_capture"),
        F.exists(F.transform("data", lambda v, i: F.trim(F.substring_index(v, "\t", 1)).try_cast("int") != i + 1), lambda b: F.coalesce(b, F.lit(True))).alias("index_inconsistent"),
        F.coalesce(rate, F.try_divide(F.lit(1.0), dt)).alias("sample_rate_hz"),
        F.coalesce(dt, F.try_divide(F.lit(1.0), rate)).alias("dt_s"),
        number(h("X-Axis first value")).alias("t0_s"),
        number(h("InputRange")).alias("input_range"),
        number(h("dBReference")).alias("db_reference"),
        (F.lower(F.element_at("tags", "OverLoad")) == "true").alias("overload"),
        F.try_to_timestamp(F.concat_ws(" ", h("Date"), h("Time")), F.lit("M/d/yyyy HH:mm:ss:SSS")).cast("timestamp_ntz").alias("captured_at"),
    )


def parse_specs(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Five lines in order: name, length, weight, caliber, diameter; and the note that stands before the file's name, "" if nothing does, null for other names."""
    line = lambda i: F.trim(F.get(F.split(F.regexp_replace(F.col(text), "\r", ""), "\n"), F.lit(i)))
    return files.select(path, line(0).alias("name"), number(line(1)).alias("length_in"), number(line(2)).alias("weight_oz"), line(3).alias("caliber"), number(line(4)).alias("max_diameter_in"), spec_note(F.element_at(F.split(path, "/"), -1)).alias("note"))


KEYS = ["event", "maker", "device", "caliber", "cartridge"]


def parse_summary(rows: DataFrame, cells: str, mics: list[str], labels: list[str], keep: list[str] | None = None) -> DataFrame:
    """Long rows (keys, mic, metric, value, shots, weight, len, maxdia) from cells (array of string) under two header rows. An unknown metric or missing
    trailing columns are errors; so is a row of another width. Blank rows are skipped, zero dimensions are null."""
    if labels[:5] != ["_EVENT_", "_MFGR_", "_SUPPRESSOR_", "_CAL_", "_CART_"] or labels[-4:] != ["shots", "weight", "len", "maxdia"]:
        raise ValueError("key or trailing columns are missing")
    if unknown := [x for x in labels[5:-4] if x not in METRICS]:
        raise ValueError(f"unknown metrics {unknown}")
    n = len(labels)
    rows = rows.where(F.exists(cells, lambda c: F.trim(c) != "")).withColumn(cells, F.when(F.size(cells) == n, F.col(cells)).otherwise(F.raise_error(F.lit("a row of another width"))))
    at = lambda i: F.element_at(F.col(cells), i + 1)
    values = F.array(*(F.struct(F.lit(mics[i]).alias("mic"), F.lit(METRICS[labels[i]]).alias("metric"), number(at(i)).alias("value")) for i in range(5, n - 4)))
    dims = [F.nullif(number(at(n - 4 + k)), F.lit(0.0)).alias(x) for k, x in enumerate(("shots", "weight", "len", "maxdia"))]
    return rows.select(*(keep or []), *(F.trim(at(i)).alias(k) for i, k in enumerate(KEYS)), *dims, F.explode(values).alias("x")).select(*(keep or []), *KEYS, "x.*", "shots", "weight", "len", "maxdia")


def link_aliases(links: DataFrame, files: DataFrame, target: str = "target", path: str = "path") -> DataFrame:
    """links whose target is a file that is there: a row for each alias."""
    return links.join(files.select(F.col(path).alias(target)), target, "left_semi")


def read_captures(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    """parse_captures of every file below a folder (latin-1, one file is one row), with the path below it and error: why a file has no samples, if it hasn't."""
    files = read_files(spark, folder, "path string, text string, error string", **options)
    parsed = parse_captures(files.withColumn("text", F.coalesce("text", F.lit(""))), keep=["error"])
    return parsed.withColumn("error", F.coalesce("error", F.when(F.size("samples") == 0, "no samples")))


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """parse_summary of published CSV files of two header rows (microphones, metrics), UTF-8 with or without a byte order mark, with the year that stands in
    their path, null if none does. Only the two header lines come to the driver. Cells that are missing at the end of a row are empty; a row with more is an
    error."""
    head = [next(csv.reader([r.value.lstrip("\ufeff")])) for r in spark.read.text(path).limit(2).collect()]
    if len(head) < 2:
        raise ValueError("two header rows are missing")
    mics, labels = ([x.strip() for x in row] for row in head)
    mics += [""] * (len(labels) - len(mics))
    names = [f"c{k}" for k in range(len(labels) + 1)]  # one more, for rows that are too wide
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(path).withColumn("year", F.nullif(F.regexp_extract(F.col("_metadata.file_path"), r"(20\d{2})", 1), F.lit("")).cast("int"))
    text = F.transform(F.array(*names), lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), "^\ufeff", "")))
    cells = rows.select("year", F.when(F.element_at(text, -1) == "", F.slice(text, 1, len(labels))).otherwise(text).alias("cells"))
    header = F.col("cells").isin(F.array(*map(F.lit, mics)), F.array(*map(F.lit, labels)))
    return parse_summary(cells.where(~header), "cells", mics, labels, keep=["year"])
