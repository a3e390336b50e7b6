"""Lists of samples stay in their rows; ranges of an order part equal values; numbers are printed by their exact value."""

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonamark.operators import offsets, statistics, views, waveform
from sonamark.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["J14_bins_in_bands", "W08_running_integral", "W09_running_rms", "W10_gap_fill", "W11_differences", "W11_restored", "P04_rice_cost", "P04_encoding_costs", "P06_quantised", "P07_envelope", "P08_decimated", "P08_decimated_aligned", "P09_triggers", "P09_envelope_triggers", "P12_aligned_overlay", "P13_downsampled"])
def test_samples_stay(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_odd_records(spark):
    """Null, empty and short records, null and NaN samples."""
    nan = float("nan")
    rows = spark.createDataFrame([(1, None), (2, []), (3, [1.0]), (4, [None, 2.0, None, 4.0, nan, 6.0, None]), (5, [-1.0, 3.0, 2.0, 5.0])], "id int, x array<double>")
    of = lambda df, c: {r.id: r[c] for r in df.collect()}
    assert of(waveform.running_integral(rows, ["id"], "x", 0.001), "integral") == {1: None, 2: [], 3: [0.0], 4: [0.0] * 7, 5: [0.0, 1.0, 3.5, 7.0]}
    assert of(waveform.gaps_filled(rows, ["id"], "x"), "filled") == {1: None, 2: [], 3: [1.0], 4: [None, 2.0, 3.0, 4.0, 5.0, 6.0, None], 5: [-1.0, 3.0, 2.0, 5.0]}
    assert of(waveform.gaps_filled(rows, ["id"], "x", 0), "filled")[4] == [None, 2.0, None, 4.0, None, 6.0, None]
    assert of(waveform.running_rms(rows, ["id"], "x", 2), "rms")[3] is None
    assert of(rows.select("id", waveform.trigger("x", 2.5).alias("t")), "t") == {1: None, 2: None, 3: None, 4: 3, 5: 1}
    assert of(waveform.encoding_costs(rows.where("id in (1, 2, 5)"), ["id"], "x"), "n").keys() == {5}
    band = waveform.decimated(rows.where("id in (2, 4)"), ["id"], "x", 0.0, 10.0, 5, 1.0)
    assert of(band, "lo") == {2: [None] * 5, 4: [2.0, 4.0, 6.0, None, None]}
    sizes = of(waveform.frame_sizes(rows.where("id in (1, 3, 5)"), ["id"], "x", buckets=2), "frame_bytes")
    assert sizes[1] is None and sizes[3] is None and sizes[5] > 28
    with pytest.raises(Exception, match="shorter than its buckets"):
        waveform.envelope(rows, ["id"], "x", 3).collect()


def test_unary_runs_are_bounded():
    x = np.zeros(4096, int)
    x[100] = 30_000
    k, bits = waveform.rice_blocks(x, 4096)
    low, more = waveform.rice_blocks(x, 4096, 4, 64)
    assert (60_000 >> int(k[0])) > 64 >= (60_000 >> int(low[0])) and more[0] > bits[0]


def test_differences_undo(spark):
    rows = spark.createDataFrame([(1, [5, -3, 8, 8, 0, 1 << 40]), (2, []), (3, [7])], "id int, q array<bigint>")
    for order in range(5):
        d = rows.select("id", waveform.differences(F.col("q"), order).alias("d"))
        assert {r.id: r.codes for r in waveform.restored(d, ["id"], "d", order).collect()} == {1: [5, -3, 8, 8, 0, 1 << 40], 2: [], 3: [7]}


def test_equal_values_are_parted(spark):
    """With one value in half of the rows, no range has more than twice the mean, and numbers are right; the order may be text."""
    rows = spark.range(6000).select(F.col("id"), F.when(F.col("id") % 2 == 0, "m").otherwise(F.format_string("%05d", F.col("id") * 7919 % 6007)).alias("v"), (F.col("id") % 5).alias("w"))
    sizes = [r["count"] for r in offsets.ranges_of(rows, ["v", "id"], 6).groupBy("_piece").count().collect()]
    assert sum(sizes) == 6000 and max(sizes) <= 2 * 6000 / 6
    order = sorted((r.v, r.id, r.w) for r in rows.collect())
    got = {r.id: (r.n, r.total) for r in offsets.prefix_sums(offsets.numbered(rows, "v", "n", tie="id"), ["v", "id"], {"w": "total"}).collect()}
    total = 0
    for k, (_, i, w) in enumerate(order):
        assert got[i] == (k + 1, total)
        total += w


def test_median(spark):
    for values in ([1.0], [2.0, 1.0], [5.0] * 50 + [1.0, 9.0], [1.0, 2.0, 2.0, 8.0], [3.0, 1.0, 2.0, None]):
        want = float(np.median([v for v in values if v is not None]))
        assert statistics.median(spark.createDataFrame([(v,) for v in values], "v double"), "v").first().median == want
    assert statistics.median(spark.createDataFrame([], "v double"), "v").first().median is None


def test_printed_numbers(spark):
    values = [1.005, 2.675, 0.125, 0.375, 1.995, -1.005, -0.125, 0.004, -0.004, 0.0, 123456.785, 99.995, 8.345, 1e11 + 0.125, *np.random.default_rng(1).uniform(-500, 500, 300).round(3).tolist()]
    got = [r.t for r in spark.createDataFrame([(v,) for v in values], "v double").select(views.display_number(F.col("v")).alias("t")).collect()]
    exact = lambda v: str(Decimal(abs(v)).quantize(Decimal("0.01"), ROUND_HALF_UP))
    assert got == [("−" if v < 0 and float(exact(v)) else "") + exact(v) for v in values]
    assert [r.t for r in spark.createDataFrame([(2.5,), (float("inf"),), (None,)], "v double").select(views.display_number(F.col("v"), 0, sign=True).alias("t")).collect()] == ["+3", "—", "—"]


def test_filter_in_blocks():
    """Blocks are the recurrence, the sections are the filter."""
    from test_queries import recursive

    for rate, n in ((262144.0, 3000), (500.0, 63), (500.0, 1)):
        x = np.random.default_rng(2).normal(0, 100, (3, n))
        want = x.tolist()
        for b, a in waveform.a_sections(rate):
            want = [recursive(b, a, row) for row in want]
        assert np.abs(waveform.weighted_by_a(x, rate) - want).max() < 1e-9
        b, a = waveform.a_weighting(rate)
        one, two = (np.array([1.0]), np.array([1.0]))
        for p, q in waveform.a_sections(rate):
            one, two = np.convolve(one, p), np.convolve(two, q)
        assert np.allclose(one, b, rtol=1e-9, atol=1e-12) and np.allclose(two, a, rtol=1e-9, atol=1e-9)


def test_curves(spark):
    """Null lists for records that can't be analysed; a record that nothing triggers is searched as a whole where that is asked for."""
    t = np.arange(200) / 2000
    loud, quiet = (100 * np.sin(40 * t)).tolist(), (0.5 * np.sin(40 * t)).tolist()
    rows = spark.createDataFrame([(1, loud), (2, quiet), (3, None), (4, [None] * 200), (5, [1.0])], "id int, samples array<double>")
    got = {r.id: r for r in waveform.curves(rows, ["id"], "samples", 0.0005).collect()}
    assert [k for k, r in got.items() if r.weighted is None] == [3, 4, 5] and got[1].pressure == loud and len(got[2].running) == 200
    waveform.register_curves(spark)
    rows.createOrReplaceTempView("some_records")
    flat = spark.sql("select id, c.* from some_records lateral view inline(shot_curves(samples, 0.0005D)) c where c.i = 150").collect()
    assert {r.id: (r.pressure, r.weighted, r.integral, r.running) for r in flat} == {k: (got[k].pressure[150], got[k].weighted[150], got[k].integral[150], got[k].running[150]) for k in (1, 2)}
    found = {r.id: r for r in waveform.shot_metrics(rows, ["id"], dt=0.0005, window=False, anyway=True).collect()}
    assert (found[2].triggered, found[2].leq_start, found[2].leq_stop, found[2].error) == (False, 0, 199, None)
    assert found[2].peak_leq_pa == max(got[2].running) and found[2].leq_index == int(np.argmax(got[2].running)) and found[1].triggered


def test_files_as_rows(spark, tmp_path):
    """Partitions by bytes, pruned columns, other encodings, unreadable files as rows, an empty folder."""
    from sonamark.sources import captures, files

    rows = spark.createDataFrame([(f"run {i}/a.txt", "\u00b5" * 100 * i) for i in range(1, 9)] + [("x/_skipped.txt", "no"), ("x/b.csv", "no")], "path string, text string")
    files.write_files(rows, f"file://{tmp_path}")
    got = files.read_files(spark, str(tmp_path), suffix=".txt", partitionBytes=1000, maxBytes=750)
    assert {r.path: (r.bytes, len(r.text or ""), r.error) for r in got.collect()} == {f"run {i}/a.txt": (100 * i, 100 * i if i < 8 else 0, None if i < 8 else "ValueError: 800 bytes are more than 750") for i in range(1, 9)}
    assert got.withColumn("p", F.spark_partition_id()).select("p").distinct().count() == 5
    (tmp_path / "run 1" / "a.txt").write_bytes(b"\xff\xfe")
    assert {r.path: r.error is None for r in files.read_files(spark, str(tmp_path), encoding="ascii", suffix="a.txt").collect()} == {f"run {i}/a.txt": False for i in range(1, 9)}
    assert files.read_files(spark, str(tmp_path), "path string, bytes long", encoding="ascii").columns == ["path", "bytes"]
    (tmp_path / "none").mkdir()
    assert captures.read_captures(spark, str(tmp_path / "none")).count() == 0
    bad = {r.path: (r.error, r.header) for r in captures.read_captures(spark, str(tmp_path), suffix=".csv").collect()}
    assert bad == {"x/b.csv": ("no samples", {})}
