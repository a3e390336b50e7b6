"""Every query with SQL, against DuckDB on the smallest tables; rules on hand-made rows."""

import hashlib
import json
import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

from sonamark.functions import levels as L
from sonamark.functions import names as N
from sonamark.operators import filters, matching, numbering, ranking, statistics, waveform
from sonamark.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.6g}" if v else str(v)  # -0.0 is not 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if v is None else str(v) if isinstance(v, (bool, str)) else f"{float(v):.6g}" if v and (isinstance(v, int) or type(v).__name__ == "Decimal") else "0.0" if isinstance(v, int) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    order = [want.columns.index(c) for c in cols]
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=key) == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=key)


def test_run_statistics(spark):
    rows = spark.createDataFrame([(1, i + 1, float(v), False) for i, v in enumerate([10, 12, 11, 13, 14])] + [(2, i + 1, float(v), False) for i, v in enumerate([20, 10, 10, 10])] + [(3, 2, 5.0, False), (3, 3, 6.0, False), (4, 1, 7.0, False), (5, 1, 1.0, True)], "run int, shot int, value double, excluded boolean")
    got = {r.run: r for r in statistics.run_statistics(rows, ["run"]).collect()}
    assert (got[1].n, got[1].mean, round(got[1].sd, 4)) == (5, 12.0, 1.5811)
    assert got[2].pop == 10.0 and got[3].pop is None and 5 not in got
    assert (got[4].sd, got[4].sem, got[4].pop) == (None, None, None)


def test_frontiers(spark):
    rng = np.random.default_rng(1)
    points = [(i, int(a), int(b), int(c), "g" if i % 3 else None) for i, (a, b, c) in enumerate(rng.integers(0, 12, (150, 3)))] + [(150, None, 1, 1, "g")]
    rows = spark.createDataFrame(points, "run int, x int, y int, z int, g string")
    over = lambda p, q, ks: all(q[k] <= p[k] for k in ks) and any(q[k] < p[k] for k in ks)

    def want(ks, group=False, mask=lambda p: True):
        some = [p for p in points[:-1] if mask(p)]
        return {p[0] for p in some if not any(over(p, q, ks) and (not group or p[4] == q[4]) for q in some)}

    three = {"x": "min", "y": "min", "z": "min"}
    assert {r.run for r in ranking.frontier2(rows, ["g"], "x", "y").collect()} == want((1, 2), True)
    assert {r.run for r in ranking.frontier(rows, three).collect()} == want((1, 2, 3))
    assert {r.run for r in ranking.frontier(rows, three, ["g"], L.F.col("run") % 2 == 0).collect()} == want((1, 2, 3), True, lambda p: p[0] % 2 == 0)
    for fit in (1, 3, 8):  # too many points for a task: pieces two by two
        assert {r.run for r in ranking.frontier(rows.repartition(5), three, ["g"], fit=fit).collect()} == want((1, 2, 3), True)
    assert ranking.frontier(rows, {}).count() == 0 and ranking.frontier(rows.limit(0), three).count() == 0
    assert {r.run for r in ranking.frontier_of_finite(rows, {"x": "min", "y": None, "z": "min"}).collect()} == want((1, 3))


def test_frontier_of_hand_made_rows(spark):
    """The five rows of the selection rules: equal rows both stay, a null keeps a row out."""
    rows = spark.createDataFrame([(0, 120.0, 10.0), (1, 120.0, 10.0), (2, 118.0, 20.0), (3, 125.0, None), (4, 126.0, 30.0)], "id int, level double, weight double")
    assert {r.id for r in ranking.frontier2(rows, [], "level", "weight").collect()} == {0, 1, 2}
    assert {r.id for r in ranking.frontier(rows, {"level": "min", "weight": "min"}).collect()} == {0, 1, 2}
    assert {r.id for r in ranking.frontier(rows, {"level": "max"}).collect()} == {4}


def test_ranks_of_large_groups(spark):
    """Ranks by ranges, with ties, a null group and pieces that split a group."""
    rng = np.random.default_rng(4)
    rows = [(i, None if i % 7 == 0 else "g" if i % 3 else "h", int(v), 0.4) for i, v in enumerate(rng.integers(0, 20, 300))]
    df = spark.createDataFrame(rows, "run int, host string, v int, sem double")
    for better in ("min", "max"):
        got = {r.run: (r.rank, r.field) for r in ranking.rank_order(df, ["host"], "v", "run", better).collect()}
        for g in (None, "g", "h"):
            own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] if better == "min" else -r[2], r[0]))
            assert [got[r[0]] for r in own] == [(k + 1, len(own)) for k in range(len(own))]
        ties = {r.host: (r.tied, r.depth) for r in ranking.leader_ties(df, ["host"], "v", "sem", "run", better).collect()}
        for g in (None, "g", "h"):
            own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] if better == "min" else -r[2], r[0]))
            tied = [k + 1 for k, r in enumerate(own) if k == 0 or abs(r[2] - own[0][2]) < 2 * math.hypot(0.4, 0.4)]
            assert ties[g] == (len(tied), max(tied))
    assert statistics.median(df, "v").first()[0] == float(np.median([r[2] for r in rows]))
    assert statistics.median(df.limit(0), "v").first()[0] is None


def test_selection(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", None), ("a", 3.0)], "k string, v double")
    assert filters.selection(rows, {"k": {"a"}, "v": (1, 2)}).count() == 1
    for bad in ({"no": {1}}, {"v": {1.0}}):
        with pytest.raises(ValueError):
            filters.selection(rows, bad)


def test_names(spark):
    r = spark.createDataFrame([("2023_SUMMIT_RELEASE_SET/20230101/YHM/R2 (.30 on .308-20BA)/Shot 3/Time Group_Expanded Time(Mil Left) - Input.x", "YHM", "R2 ")], "p string, m string, d string")
    parts, f = N.member_parts("p"), N.capture_file("file")
    got = r.select(*(c.alias(k) for k, c in parts.items()), N.device_key("m", "d").alias("key")).select("*", *(c.alias(k) for k, c in f.items()), *(c.alias(k) for k, c in N.run_dir_parts("run_dir").items())).first()
    assert (got.shot, got.mic, got.excluded, got.maker, got.cartridge, got.key) == (3, "ML", True, "YHM", ".308-20BA", "yankee-hill-machine/r2")


#: The filter at 262,144 Hz.
B_262144 = [0.020250742138132646, -0.04050148427626529, -0.020250742138132664, 0.08100296855253057, -0.020250742138132667, -0.04050148427626529, 0.020250742138132646]
A_262144 = [1.0, -5.468885860134451, 12.420283198189104, -14.990869075242912, 10.13977090761079, -3.6436380783526627, 0.5433389079308478]


def test_a_weighting():
    b, a = waveform.a_weighting(262144.0)
    assert np.allclose(b, B_262144, rtol=0, atol=1e-14) and np.allclose(a, A_262144, rtol=0, atol=1e-13)
    for hz, db in ((100, -19.1), (1000, 0.0), (4000, 1.0), (10000, -2.5)):
        z = np.exp(-2j * np.pi * hz / 262144)
        assert abs(20 * np.log10(abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z))) - db) < 0.3
    assert np.allclose(waveform.running_level(np.full((1, 500), 3.0), 20), 3.0)


def test_window(spark):
    """32,507 samples, 25,953 where it is short: a cartridge that begins with .22, not before 2024."""
    (a, b), (c, d) = waveform.bounds(waveform.DT, waveform.WINDOW_LONG), waveform.bounds(waveform.DT, waveform.WINDOW_SHORT)
    assert (a, b - a + 1, c, d - c + 1) == (262, 32507, 262, 25953)
    rows = spark.createDataFrame([(".22LR", 2024), (".22LR", None), (".22LR", 2023), (".300BO", 2025)], "cartridge string, year int")
    assert [r[0] for r in rows.select(waveform.short_window(L.F.col("cartridge"), L.F.col("year"))).collect()] == [True, True, False, False]


def recursive(b, a, x):
    """A filter of second order, sample by sample."""
    y = []
    for i, v in enumerate(x):
        at = lambda s, k: s[i - k] if i >= k else 0.0
        y.append(b[0] * v + b[1] * at(x, 1) + b[2] * at(x, 2) - a[1] * at(y, 1) - a[2] * at(y, 2))
    return y


def straight(x, dt, rate, stop):
    """The metrics of one record, sample by sample."""
    half = lambda v: math.floor(v + 0.5)
    w = x[half(0.001 / dt) - 1 : half(stop / dt)]
    peak_n, tau = half(0.075 * rate), math.floor(0.010 * rate)
    integral, run = [0.0], 0.0
    for p, q in zip(w, w[1:]):
        run += (p + q) / 2 * dt * 1000
        integral.append(run)
    trough = min(range(min(peak_n, len(w))), key=integral.__getitem__)
    y = w.tolist()
    for b, a in waveform.a_sections(rate):
        y = recursive(b, a, y)
    start = next((i for i, p in enumerate(w) if p > 1), None)
    level = [math.sqrt(sum(y[(i - k) % len(w)] ** 2 for k in range(tau)) / tau) for i in range(start, min(len(w), start + half(0.025 * rate) + 1))]
    return max(w[:peak_n]), max(y[:peak_n]), max(integral[: trough + 1]), max(level), trough, start


def test_metrics_of_a_true_record(spark):
    """At the true sample step, short enough to sum up by hand."""
    rate = 262144.0
    rng = np.random.default_rng(3)
    n = 3500
    t = np.arange(n) * waveform.DT
    x = 300 * np.exp(-((t - 0.004) / 0.0004) ** 2) - 200 * np.exp(-((t - 0.006) / 0.0015) ** 2) + rng.normal(0, 0.05, n)
    rows = spark.createDataFrame([(1, x.tolist())], "id int, samples array<double>")
    got = waveform.shot_metrics(rows, ["id"], rate=rate).first()
    want = straight(x, waveform.DT, rate, 0.125)
    assert np.allclose([got.peak_pa, got.peak_a_pa, got.impulse_pa_ms, got.peak_leq_pa], want[:4], rtol=1e-5) and (got.trough_index, got.leq_start) == want[4:]
    assert got.error is None and got.trough_index != int(x[261:].argmin())  # not where the pressure is least
    assert waveform.shot_metrics(rows.limit(1), ["id"], rate=rate, short=L.F.lit(True)).first().peak_pa == got.peak_pa


def test_gap_rules():
    x = np.array([1.0, np.nan, 3.0])
    assert waveform.filled(x).tolist() == [1.0, 2.0, 3.0]
    for bad in ([np.nan, 1.0], [1.0, *[np.nan] * 9, 2.0]):
        with pytest.raises(ValueError):
            waveform.filled(np.array(bad))


def test_shot_metrics_errors(spark):
    rows = spark.createDataFrame([(1, [0.0, 5.0, -2.0, 1.0]), (2, [0.1, 0.2, 0.1]), (3, None), (4, []), (5, [0.0, 5.0] + [math.nan] * 9 + [1.0])], "id int, samples array<double>")
    got = {r.id: r for r in waveform.shot_metrics(rows, ["id"], window=False, tau_s=2 * waveform.DT).collect()}
    assert got[3].error == got[4].error == "no samples" and "gap" in got[5].error
    assert got[1].peak_pa == 5.0 and got[1].error is None and (got[1].trough_index, got[1].impulse_index) == (0, 0)
    assert got[2].error and got[2].peak_leq_pa is None and got[2].peak_pa == 0.2
    got = {r.id: r for r in waveform.shot_metrics(rows, ["id"], window=False).collect()}
    assert "integration time" in got[1].error and got[1].peak_pa is None
    assert waveform.shot_metrics(rows.limit(0), ["id"]).count() == 0


def test_paths(spark):
    good = "Day1/YHM/R2 (a) (.30 on .308 on x)"
    rows = spark.createDataFrame([(p,) for p in (f"{good}/Shot 12/f", f"/{good}/f", f"2023_SUMMIT_RELEASE_SET/{good}/Shot 3/f", f"{good}/XX Shot 4 did not record/f", f"{good}/Shot/f", "a/b", f"{good}/Shot 1/x/f", "", None)], "p string")
    got = [tuple(r) for r in rows.select(*(c for c in N.member_parts("p").values())).collect()]
    assert got == [(good, 12, "f"), (good, None, "f"), (good, 3, "f"), *[(None, None, None)] * 6]
    parts = rows.limit(1).select(*(c.alias(k) for k, c in N.run_dir_parts(L.F.lit(good)).items())).first()
    assert tuple(parts) == ("Day1", "YHM", "R2 (a)", ".30", ".308 on x")
    assert all(v is None for r in rows.limit(1).select(*N.run_dir_parts(L.F.lit("Day1/YHM/R2 .30 on .308")).values()).collect() for v in r)
    names = ["Time Group_Expanded Time(Mil Left) - Input", "Time Group_Expanded Time( Right Ear ) - Input.x", "Time Group_Expanded Time(odd) - Input.7", "Time Group_Expanded Time(Mil Left) - Input.y", "Specs.txt", None]
    got = [tuple(r) for r in spark.createDataFrame([(n,) for n in names], "n string").select(*N.capture_file("n").values()).collect()]
    assert got == [("Mil Left", "ML", "txt", False), (" Right Ear ", "SE", "x", True), ("odd", None, "7", False), (None, None, None, False), (None, None, None, False), (None, None, None, False)]
    notes = [r[0] for r in spark.createDataFrame([(n,) for n in ("Specs.txt", "No Thread on Spec.txt", "MySpecs.txt", "x.txt")], "n string").select(N.spec_note("n")).collect()]
    assert notes == ["", "No Thread on", None, None]


def test_shot_numbers(spark):
    """Stated numbers are kept and spares follow the highest; else by time; else by suffix, txt last."""
    rows = [(1, "a", 4, None, "1", "f1", False), (1, "a", 2, None, "2", "f2", False), (1, "a", None, None, "x", "f0", True), (1, "a", 9, None, "x", "f9", True)]
    rows += [(2, "a", None, 30, "txt", "f1", False), (2, "a", 1, 10, "2", "f2", False), (2, "a", None, 20, "1", "f3", False), (2, "a", None, None, "x", "f4", True)]
    rows += [(3, "a", None, None, "txt", "f1", False), (3, "a", None, 5, "2", "f2", False), (3, "a", None, 6, "10", "f3", False)]
    rows += [(4, "a", None, None, "x", "f1", True)]
    df = spark.createDataFrame(rows, "run int, signal string, folder int, at int, suffix string, file string, spare boolean")
    got = {(r.run, r.file): (r.shot, r.rule) for r in numbering.shot_numbers(df, ["run", "signal"], "folder", "at", "suffix", "file", "spare").collect()}
    assert got == {
        (1, "f1"): (4, "folder"), (1, "f2"): (2, "folder"), (1, "f0"): (5, "folder"), (1, "f9"): (6, "folder"),
        (2, "f2"): (1, "time"), (2, "f3"): (2, "time"), (2, "f1"): (3, "time"), (2, "f4"): (4, "time"),
        (3, "f3"): (1, "name"), (3, "f2"): (2, "name"), (3, "f1"): (3, "name"), (4, "f1"): (1, "time"),
    }


def test_close_numbers_share_a_cell(spark):
    rng = np.random.default_rng(6)
    a = np.concatenate([rng.uniform(-1, 1, 300), 10 ** rng.uniform(-3, 12, 300) * rng.choice([-1, 1], 300), [0.0, 1.0, -1.0]])
    b = np.concatenate([a[:-3] * (1 + rng.uniform(-1, 1, 600) * 0.99e-9), [0.9e-9, 1 + 0.9e-9, -1 - 0.9e-9]])
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    assert df.where(matching.close("a", "b")).count() == len(a)
    assert df.where(matching.close("a", "b") & ~L.F.array_contains(matching.cells("a")[1], matching.cells("b")[0])).count() == 0


def test_sinks_and_stream(spark):
    """What has no SQL: the version depends on rows only, spectra are rounded, the inputs' sums are those of the files, the stream adds nothing twice."""
    a, b = QUERIES["S19_content_version"](spark, SF).first()[0], QUERIES["S19_content_version"](spark, SF).first()[0]
    assert a == b and len(a) == 12
    rows = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    from sonamark.sources import store

    assert store.version(rows, ["k", "v"]).first()[0] == store.version(rows.repartition(3).orderBy("k"), ["k", "v"]).first()[0] != store.version(rows.limit(1), ["k", "v"]).first()[0]
    raw = {r.id: r.levels for r in waveform.third_octaves(spark.read.parquet(f"{SF}/embeddings.parquet").select(L.F.col("vec_id").alias("id"), L.F.transform("embedding", lambda x: x.cast("double") * 500).alias("samples")), ["id"], "samples", 1 / 40_000).collect()}
    for r in QUERIES["S20_spectra"](spark, SF).collect():
        assert all(x is None and y is None or abs(x - y) <= 0.0501 for x, y in zip(json.loads(r.spectrum), raw[r.id]))
    one = QUERIES["S21_provenance"](spark, SF).first()
    data = Path(f"{SF}/embeddings.parquet").read_bytes()
    assert (one.bytes, one.sha256) == (len(data), hashlib.sha256(data).hexdigest())
    got = QUERIES["R01_incremental_metrics"](spark, SF).collect()
    assert len(got) == len({r.id for r in got}) == len(raw)
    records = spark.read.parquet(f"{SF}/embeddings.parquet").select(L.F.col("vec_id").alias("id"), L.F.transform("embedding", lambda x: x.cast("double") * 500).alias("samples"))
    straightly = {r.id: round(r.peak_pa, 5) for r in waveform.shot_metrics(records, ["id"], "samples", 0.002).collect()}
    assert {r.id: r.peak_pa for r in got} == straightly


def test_readers(spark, tmp_path):
    """A published file with a byte order mark and two header rows; exports in latin-1, one of them cut."""
    from sonamark.sources import captures

    lines = [",,,,,SE,ML,,,,", "_EVENT_,_MFGR_,_SUPPRESSOR_,_CAL_,_CART_,PkPr,dB,shots,weight,len,maxdia", "Day1,YHM,R2,.30,.308,10.5,130.25,5,12.5,0.0,1.5", "", 'Day1,"A, B",R3,.30,.308,1d,,4,,7,']
    folder = tmp_path / "summit2024"
    folder.mkdir()
    (folder / "all.csv").write_bytes(b"\xef\xbb\xbf" + "\r\n".join(lines).encode() + b"\r\n")
    got = {(r.device, r.mic): r for r in captures.read_summary(spark, f"file://{folder}/all.csv").collect()}
    assert len(got) == 4 and {r.year for r in got.values()} == {2024}
    assert (got["R2", "SE"].metric, got["R2", "SE"].value, got["R2", "ML"].value, got["R2", "SE"].len) == ("peak_pressure_pa", 10.5, 130.25, None)
    assert (got["R3", "SE"].value, got["R3", "ML"].value, got["R3", "SE"].maker, got["R3", "SE"].weight, got["R3", "SE"].len) == (None, None, "A, B", None, 7.0)
    (folder / "wide.csv").write_text("\n".join([*lines[:2], lines[2] + ",9"]))
    with pytest.raises(Exception, match="width"):
        captures.read_summary(spark, f"file://{folder}/wide.csv").collect()
    text = ["X-Axis size:\t5", "X-Axis delta:\t2.5e-05", "AmplitudeUnit:\t\xb5Pa", "Date:\t13/40/2024", "Time:\t10:11:12:345", "1\t 0\t 1.5", "2\t 2.5e-05\t bad", "9\t 5e-05\t -2", "TagsBegin:", "OverLoad:\t \tTrue", "TagsEnd:"]
    (tmp_path / "run" / "Shot 1").mkdir(parents=True)
    (tmp_path / "run" / "Shot 1" / "a.txt").write_bytes("\r\n".join(text).encode("latin-1"))
    r = captures.read_captures(spark, f"file://{tmp_path}/run").first()
    assert r.header == {"X-Axis size": "5", "X-Axis delta": "2.5e-05", "AmplitudeUnit": "\xb5Pa", "Date": "13/40/2024", "Time": "10:11:12:345"} and r.tags == {"OverLoad": "True"}
    assert r.truncated and r.index_inconsistent and r.captured_at is None and r.overload and math.isnan(r.samples[1]) and [(d.idx, d.raw) for d in r.defects] == [(1, "bad")]
