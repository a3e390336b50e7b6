"""Queries that do the whole job keep every row of their inputs."""

import duckdb
from pyspark.sql import functions as F

from sonamark.operators import filters
from sonamark.plans.catalogue import ORACLE_SQL, QUERIES
from sonamark.plans.relational import CAVEATS

SF = "/root/testdata/sf0.001"


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_every_shot(spark):
    n = read(spark, "lineitem").join(read(spark, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).count()
    assert n > 5000
    for name in ("J03_shot_view_all", "C08_caveat_mask_all"):
        assert QUERIES[name](spark, SF).count() == n
    year, host, mics, severity, _ = CAVEATS[0]
    runs = {r.o_orderkey for r in read(spark, "orders").where((F.year("o_orderdate") == year) & (F.col("o_orderpriority") == host)).collect()}
    want = sum(r.l_orderkey in runs and r.l_returnflag in mics for r in read(spark, "lineitem").collect())
    assert want and QUERIES["C08_caveat_mask_all"](spark, SF).where(F.col("severity") == severity).count() == want


def test_every_year(spark):
    orders = read(spark, "orders").select("o_orderkey", F.year("o_orderdate").alias("year")).collect()
    years = {r.year for r in orders}
    assert len(years) > 3
    runs = QUERIES["A08_runs_by_host_and_year"](spark, SF).collect()
    assert sum(r.runs for r in runs) == len(orders) and {r.year for r in runs} == years
    got = QUERIES["U01_accumulate_all_years"](spark, SF).collect()
    assert sorted((r.run, r.year) for r in got) == sorted(map(tuple, orders))


def test_years_of_odd_tables(spark, tmp_path):
    """Undated runs stay, and no runs make no rows."""
    o = read(spark, "orders")
    o.limit(5).withColumn("o_orderdate", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate"))).write.parquet(f"{tmp_path}/some/orders.parquet")
    o.limit(0).write.parquet(f"{tmp_path}/none/orders.parquet")
    assert [QUERIES["U01_accumulate_all_years"](spark, f"{tmp_path}/{k}").count() for k in ("some", "none")] == [5, 0]


def test_published_halves(spark, tmp_path):
    """A mean of 1.005 is published as 1.0, since the double times 100 is below that half, and one of 2.675 as 2.68, since it is not."""
    rows = [(1, "A", 1, 1.0, 1.0, 1.0), (1, "A", 6, 1.01, 1.0, 1.001), (2, "A", 1, 2.67, 2.0, 0.01), (2, "A", 7, 2.68, 2.1, 0.02), (9, "R", 2, 5.0, 3.0, 0.0)]
    spark.createDataFrame(rows, "l_partkey long, l_returnflag string, l_linenumber int, l_extendedprice double, l_quantity double, l_tax double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL["A17_verify"]).fetchall()
    got = [tuple(r) for r in QUERIES["A17_verify"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and ("price", 3, 2, 0.02) in got


def test_verified_cells_of_odd_tables(spark, tmp_path):
    """Cells of missing values are counted as in SQL, also where a column has no others, and so large a mean that its product with 100 is no double is published as it is."""
    con = duckdb.connect()
    for name, rows, some in (("missing", [(1, "A", 1, None, 1.0, None), (1, "A", 6, None, 2.0, None), (2, "A", 1, 5.0, None, None)], ("tax", 2, 0, None)), ("huge", [(1, "A", 1, 1e308, 2.0, 1e306), (1, "A", 7, 3.0, 2.0, 1e300), (2, "A", 1, 1.0, 2.0, 3.0)], ("price", 2, 1, 5e307))):
        spark.createDataFrame(rows, "l_partkey long, l_returnflag string, l_linenumber int, l_extendedprice double, l_quantity double, l_tax double").coalesce(1).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        con.sql(f"create or replace view lineitem as select * from '{tmp_path}/{name}/lineitem.parquet/*.parquet'")
        got = {tuple(r) for r in QUERIES["A17_verify"](spark, f"{tmp_path}/{name}").collect()}
        assert some in got and got == set(con.sql(ORACLE_SQL["A17_verify"]).fetchall())


def test_years_meet_as_distinct_ones(spark):
    """Asked years meet the distinct years that are present, not all runs: those would come to a few tasks. Where none is left all stay, undated runs too."""
    plan = QUERIES["F06_active_years"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    semi = [i for i, line in enumerate(plan) if "Join LeftSemi" in line]
    assert len(semi) == 2 and all("Aggregate" in plan[i + 1] for i in semi)
    present = spark.createDataFrame([(1996,), (1996,), (None,), (1999,)], "year int")
    years = lambda *asked: sorted((r.year for r in filters.years_or_all(spark.createDataFrame([(y,) for y in asked], "year int"), present, "year").collect()), key=str)
    assert years(1996, 1996, 2050) == [1996] and years(None) == years(2050) == years() == [1996, 1999, None]
