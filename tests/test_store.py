"""Versions of a stored table, a stream that is interrupted between its sinks, and digests of streamed files."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sonamark.operators import waveform
from sonamark.sources import store
from sonamark.sources.versions import YearTable
from sonamark.streaming.incremental import compacted, incremental, landed

SF = "/root/testdata/sf0.001"


def rows_of(spark, years, value=1.0):
    return spark.createDataFrame([(i, y, value) for i, y in enumerate(years)], "run long, year int, value double")


def contents(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_versions(spark, tmp_path):
    table = YearTable(spark, f"file://{tmp_path}/t")
    assert table.versions() == [] and table.state()[0] == 0
    with pytest.raises(ValueError, match="nothing is stored"):
        table.read()
    assert table.load(rows_of(spark, [2023, 2023, 2024])) == 1
    with pytest.raises(ValueError, match="stored already"):
        table.load(rows_of(spark, [2024, 2025]))
    assert table.load(rows_of(spark, [2025, None])) == 2 and table.load(rows_of(spark, [2024], 9.0), replace=True) == 3
    assert contents(table.read()) == sorted([(0, 2023, 1.0), (1, 2023, 1.0), (0, 2024, 9.0), (0, 2025, 1.0), (1, None, 1.0)], key=str)
    assert contents(table.read(1)) == sorted([(0, 2023, 1.0), (1, 2023, 1.0), (2, 2024, 1.0)], key=str)
    with pytest.raises(ValueError, match="columns"):
        table.load(rows_of(spark, [2030]).drop("value"))
    with pytest.raises(ValueError, match="no version"):
        table.read(7)
    assert len(list((tmp_path / "t" / "data").iterdir())) == 3
    table.vacuum()
    assert table.versions() == [3] and table.read().count() == 5 and len(list((tmp_path / "t" / "data").iterdir())) == 3


def test_a_load_that_dies(spark, tmp_path, monkeypatch):
    """Between writing and swapping, in writing, or because another load was faster: readers see the version before, and nothing is left."""
    table = YearTable(spark, f"file://{tmp_path}/t")
    table.load(rows_of(spark, [2023]))
    want = contents(table.read())

    def dies(version, state):
        assert contents(table.read()) == want and len(list((tmp_path / "t" / "data").iterdir())) == 2
        raise KeyboardInterrupt

    monkeypatch.setattr(table, "_commit", dies)
    with pytest.raises(KeyboardInterrupt):
        table.load(rows_of(spark, [2023, 2024], 5.0), replace=True)
    monkeypatch.undo()
    assert contents(table.read()) == want and table.versions() == [1] and len(list((tmp_path / "t" / "data").iterdir())) == 1
    with pytest.raises(Exception, match="broken row"):
        table.load(rows_of(spark, [2024]).withColumn("value", F.when(F.col("run") >= 0, F.raise_error(F.lit("broken row")))))
    assert contents(table.read()) == want and len(list((tmp_path / "t" / "data").iterdir())) == 1
    other, swap = YearTable(spark, f"file://{tmp_path}/t"), table._commit

    def late(version, state):
        other.load(rows_of(spark, [2030]))
        swap(version, state)

    monkeypatch.setattr(table, "_commit", late)
    with pytest.raises(ValueError, match="another load"):
        table.load(rows_of(spark, [2031]))
    assert sorted(r.year for r in table.read().collect()) == [2023, 2030] and len(list((tmp_path / "t" / "data").iterdir())) == 2


def test_a_stream_that_dies_between_sinks(spark, tmp_path):
    raw = spark.read.parquet(f"{SF}/embeddings.parquet").limit(60)
    inbox, target = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    raw.repartition(3).write.parquet(inbox)
    source = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(inbox).select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double") * 500).alias("samples"))
    calls = []

    def job(batch):
        calls.append(1)
        return waveform.shot_metrics_and_bands(batch, ["id"], "samples", 0.002, -20, -6)

    bad = {"metrics": ["id", "peak_pa"], "bands": ["id", "no_such_column"]}
    with pytest.raises(Exception, match="no_such_column"):
        incremental(spark, source, "id", job, bad, target, f"{tmp_path}/progress", "one")
    assert landed(spark, target, "metrics").count() == 20  # the first sink has the batch, the second has not
    sinks = {"metrics": ["id", "peak_pa"], "bands": ["id", "levels"]}
    incremental(spark, source, "id", job, sinks, target, f"{tmp_path}/progress", "one")
    assert len(calls) == 4
    ids = sorted(r.vec_id for r in raw.collect())
    for sink in sinks:
        assert sorted(r.id for r in landed(spark, target, sink).collect()) == ids
    incremental(spark, source, "id", job, sinks, target, f"{tmp_path}/progress", "one")  # nothing new
    incremental(spark, source, "id", job, sinks, target, f"{tmp_path}/again", "two")  # another stream: nothing that is not there
    assert sorted(r.id for r in landed(spark, target, "bands").collect()) == ids
    small = compacted(spark, target, "metrics", f"file://{tmp_path}/small", 1)
    assert sorted(r.id for r in small.collect()) == ids and len(list((tmp_path / "small").glob("*.parquet"))) == 1
    records = raw.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double") * 500).alias("samples"))
    assert contents(small) == contents(waveform.shot_metrics(records, ["id"], "samples", 0.002).select("id", "peak_pa"))
    levels = waveform.third_octaves(records.select("id", waveform.analysis_window(F.col("samples"), 0.002, F.lit(False)).alias("samples")), ["id"], "samples", 0.002, -20, -6)
    assert contents(landed(spark, target, "bands")) == contents(levels)


def test_digests_of_streamed_files(spark, tmp_path, monkeypatch):
    (tmp_path / "a").mkdir()
    for name, data in (("a/x.bin", bytes(range(256)) * 5000), ("y.bin", b"")):
        (tmp_path / name).write_bytes(data)
    got = {r.file: (r.bytes, r.sha256) for r in store.provenance(spark, str(tmp_path)).collect()}
    assert got == {"x.bin": (1_280_000, hashlib.sha256(bytes(range(256)) * 5000).hexdigest()), "y.bin": (0, hashlib.sha256(b"").hexdigest())}
    plan = store.provenance(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "content" not in plan
