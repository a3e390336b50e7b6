"""Names the queries and keeps their SQL beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tables_as_views(spark: SparkSession, sf: str, *names: str) -> None:
    for name in names:
        table(spark, sf, name).createOrReplaceTempView(name)


def rounded(df: DataFrame, *cols: str, to: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, to) for c in cols})


def shots(spark: SparkSession, sf: str) -> DataFrame:
    """Measurements: run, mic, shot, value, excluded; shots are numbered by time within run and microphone."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("mic"), "ts", "event_id", "value")
    return e.withColumns({"shot": F.row_number().over(W.partitionBy("run", "mic").orderBy("ts", "event_id")).cast("long"), "excluded": F.col("event_id") % 11 == 0})


SHOTS = "(select user_id run, event_type mic, ts, event_id, value, row_number() over (partition by user_id, event_type order by ts, event_id) shot, event_id % 11 = 0 excluded from events)"


def devices(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of devices: run, maker, model, host, weight, price, sem, is_baseline."""
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("run"), F.col("p_brand").alias("maker"), F.col("p_name").alias("model"), F.col("p_type").alias("host"), F.col("p_size").cast("double").alias("weight"), F.col("p_retailprice").alias("price"), ((F.col("p_partkey") % 7) / 10 + 0.05).alias("sem"), (F.col("p_brand") == "Brand#1").alias("is_baseline"))


DEVICES = "(select p_partkey run, p_brand maker, p_name model, p_type host, p_size::double weight, p_retailprice price, (p_partkey % 7) / 10.0::double + 0.05::double sem, p_brand = 'Brand#1' is_baseline from part)"


def tests(spark: SparkSession, sf: str) -> DataFrame:
    """Published runs: run, year, host, value, is_baseline, client."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("run"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("host"), F.col("o_totalprice").alias("value"), (F.col("o_orderstatus") == "P").alias("is_baseline"), F.col("o_custkey").alias("client"))


TESTS = "(select o_orderkey run, year(o_orderdate)::int as year, o_orderpriority host, o_totalprice as value, o_orderstatus = 'P' is_baseline, o_custkey client from orders)"
