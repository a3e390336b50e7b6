"""Queries of the sources, sinks, stream and catalogue. Texts to parse are rendered from the tables by Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import ranking, statistics, waveform
from ..operators import views as V
from ..operators.offsets import prefix_sums
from ..sources import captures, files, store
from ..sources.versions import YearTable
from ..streaming.incremental import incremental, landed
from .registry import DEVICES, SHOTS, devices, query, rounded, shots, table
from .stored import TABLES, VIEW_RUN, stored
from .waves import DT, LONG, WIDE_DT, curves, db, records

LABELS = ["_EVENT_", "_MFGR_", "_SUPPRESSOR_", "_CAL_", "_CART_", "PkPr", "dB", "PkPr", "shots", "weight", "len", "maxdia"]
MICS = ["", "", "", "", "", "ML", "ML", "SE", "", "", "", ""]


@query("S01_summary", f"""with r as (select *, run % 9 = 0 hole from {DEVICES}), u as (select run, maker, model, host, weight, 'ML' mic, 'peak_pressure_pa' metric, price as value from r union all select run, maker, model, host, weight, 'ML', 'peak_db', case when hole then null else sem end from r union all select run, maker, model, host, weight, 'SE', 'peak_pressure_pa', weight from r)
    select run::varchar as "event", maker, model device, '.30' caliber, host cartridge, mic, metric, round(value, 6) as value, 5.0::double shots, weight, null::double len, 1.5::double maxdia from u""")
def s01(s, d):
    text = [F.col("run").cast("string"), "maker", "model", F.lit(".30"), "host", F.col("price").cast("string"), F.when(F.col("run") % 9 == 0, "1d").otherwise(F.col("sem").cast("string")), F.col("weight").cast("string"), F.lit("5"), F.col("weight").cast("string"), F.lit("0.0"), F.lit("1.5")]
    return rounded(captures.parse_summary(devices(s, d).select(F.array(*text).alias("cells")), "cells", MICS, LABELS), "value")


def exports(s, d):
    """A capture export for each record, with a damaged token in some and an undefined tail in others."""
    tail = F.when(F.col("label") == 3, 70).otherwise(0)
    rows = F.transform("samples", lambda p, i: F.concat_ws("\t", (i + 1).cast("string"), F.format_string("  %.10e", (i * DT)), F.when((F.col("label") == 4) & (i == 7), "bad").otherwise(F.concat(F.lit(" "), F.round(p, 3).cast("string")))))
    more = F.transform(F.sequence(F.lit(1), F.greatest(tail, F.lit(1))), lambda k: F.concat_ws("\t", (k + 64).cast("string"), F.lit("0"), F.lit("Undefined")))
    data = F.when(tail > 0, F.concat(rows, more)).otherwise(rows)
    head = F.array(F.lit("X-Axis size:\t64\t "), F.lit("X-Axis delta:\t2.5e-05"), F.lit("X-Axis first value:\t \t0"), F.lit("dBReference:\t2e-05"), F.lit("Date:\t3/7/2024"), F.lit("Time:\t10:11:12:345"))
    foot = F.array(F.lit("TagsBegin:"), F.lit("OverLoad:\t \tFalse"), F.lit("TagsEnd:"))
    return records(s, d).select(F.col("id").cast("string").alias("path"), F.array_join(F.concat(head, data, foot), "\r\n").alias("text"))


@query("S03_captures", """select vec_id::varchar path, 64::int n, case when label = 3 then 70 else 0 end::int dropped_tail, label = 3 short_capture, false truncated, false index_inconsistent, case when label = 4 then 1 else 0 end::int defects, 40000.0::double sample_rate_hz, false overload, timestamp '2024-03-07 10:11:12.345' captured_at from embeddings""")
def s03(s, d):
    return captures.parse_captures(exports(s, d)).select("path", F.size("samples").alias("n"), "dropped_tail", "short_capture", "truncated", "index_inconsistent", F.size("defects").alias("defects"), F.round("sample_rate_hz", 6).alias("sample_rate_hz"), "overload", "captured_at")


@query("S01_summary_files", f"""with r as (select *, run % 9 = 0 hole from {DEVICES}), u as (select run, maker, model, host, weight, 'ML' mic, 'peak_pressure_pa' metric, price as value from r union all select run, maker, model, host, weight, 'ML', 'peak_db', case when hole then null else sem end from r union all select run, maker, model, host, weight, 'SE', 'peak_pressure_pa', weight from r)
    select (2023 + run % 3)::int as year, run::varchar as "event", maker, model device, '.30' caliber, host cartridge, mic, metric, round(value, 6) as value, 5.0::double shots, weight, null::double len, 1.5::double maxdia from u""")
def s01b(s, d):
    """A CSV file for each year, with a byte order mark and two header rows, written and read."""
    cells = [F.col("run").cast("string"), "maker", "model", F.lit(".30"), "host", F.col("price").cast("string"), F.when(F.col("run") % 9 == 0, "1d").otherwise(F.col("sem").cast("string")), F.col("weight").cast("string"), F.lit("5"), F.col("weight").cast("string"), F.lit("0.0"), F.lit("1.5")]
    lines = devices(s, d).select((2023 + F.col("run") % 3).alias("year"), F.concat_ws(",", *(F.concat(F.lit('"'), c, F.lit('"')) for c in cells)).alias("line"))
    head = "\ufeff" + ",".join(MICS) + "\r\n" + ",".join(LABELS)
    # About a thousand lines to a file, however many there are.
    texts = lines.withColumn("part", F.pmod(F.xxhash64("line"), F.lit(lines.count() // 3000 + 1))).groupBy("year", "part").agg(F.concat_ws("\r\n", F.lit(head), F.concat_ws("\r\n", F.collect_list("line")), F.lit("")).alias("text"))
    folder = store.fresh_folder(s, "summaries")
    files.write_files(texts.select(F.format_string("summit%d/all-%d.csv", "year", "part").alias("path"), "text"), folder, "utf-8")
    return rounded(captures.read_summary(s, f"{folder}/*/*.csv"), "value")


@query("S03_capture_files", """select case when label = 5 then vec_id || '/cut.txt' else vec_id || '/Time.txt' end path, case when label = 5 then 0 else 64 end::int n, case when label = 3 then 70 else 0 end::int dropped_tail, case when label = 4 then 1 else 0 end::int defects, case when label <> 5 then 40000.0::double end sample_rate_hz, case when label <> 5 then timestamp '2024-03-07 10:11:12.345' end captured_at, case when label = 5 then 'no samples' end error from embeddings""")
def s03b(s, d):
    """A file for each record, in latin-1, some of them cut off in the header; written and read by the data source."""
    folder, cut = store.fresh_folder(s, "captures"), F.col("label") == 5
    texts = exports(s, d).join(records(s, d).select(F.col("id").cast("string").alias("path"), "label"), "path")
    texts = texts.select(F.concat("path", F.when(cut, "/cut.txt").otherwise("/Time.txt")).alias("path"), F.when(cut, F.lit("\u00b5Pa")).otherwise(F.col("text")).alias("text"))
    files.write_files(texts, folder)
    found = captures.read_captures(s, folder, partitionBytes=100_000)
    return found.select("path", F.size("samples").alias("n"), "dropped_tail", F.size("defects").alias("defects"), F.round("sample_rate_hz", 6).alias("sample_rate_hz"), "captured_at", "error")


@query("S05_amplitudes", f"select id::varchar path, i, round(p, 3) p from {LONG} where not (label = 4 and i = 7)")
def s05(s, d):
    x = captures.parse_captures(exports(s, d)).select("path", F.posexplode("samples").alias("i", "p")).where(~F.isnan("p"))
    return x.select("path", F.col("i").cast("long").alias("i"), F.round(F.col("p").cast("double"), 3).alias("p"))


PATHS = f"(select run, '20240' || (101 + run % 9) || '/' || maker || '/' || model || ' (.30 on ' || host || ')/Shot ' || (run % 5 + 1) || '/Time Group_Expanded Time(Mil Left) - Input' || case when run % 4 = 0 then '.x' else '.txt' end path from {DEVICES})"


def paths(s, d):
    return devices(s, d).select("run", "maker", "model", "host", F.concat(F.lit("20240"), (101 + F.col("run") % 9).cast("string"), F.lit("/"), "maker", F.lit("/"), "model", F.lit(" (.30 on "), "host", F.lit(")/Shot "), (F.col("run") % 5 + 1).cast("string"), F.lit("/Time Group_Expanded Time(Mil Left) - Input"), F.when(F.col("run") % 4 == 0, ".x").otherwise(".txt")).alias("path"))


LAYOUT = "case run % 6 when 0 then 'void' when 1 then 'flat' when 2 then 'slash' when 3 then 'shallow' else 'shot' end"


@query("S09_member_paths", f"""select run, case when k not in ('void', 'shallow') then 'Day1/' || maker || '/' || model || ' (.30 on ' || host || ')' end run_dir, case when k in ('shot', 'slash') then (run % 5 + 1)::int end shot, case when k not in ('void', 'shallow') then 'a.txt' end file from (select *, {LAYOUT} k from {DEVICES})""")
def s09(s, d):
    """With shot folders and without, under a release folder, with a leading slash; a folder of a failed shot and a shallow file are no members."""
    run_dir, k, shot = F.concat(F.lit("Day1/"), "maker", F.lit("/"), "model", F.lit(" (.30 on "), "host", F.lit(")")), F.expr(LAYOUT), (F.col("run") % 5 + 1).cast("string")
    in_shot = F.concat(run_dir, F.lit("/Shot "), shot, F.lit("/a.txt"))
    path = F.when(k == "void", F.concat(run_dir, F.lit("/XX Shot 4 did not record/a.txt"))).when(k == "flat", F.concat(run_dir, F.lit("/a.txt"))).when(k == "slash", F.concat(F.lit("/"), in_shot)).when(k == "shallow", F.concat("maker", F.lit("/a.txt"))).otherwise(F.concat(F.lit("2023_SUMMIT_RELEASE_SET/"), in_shot))
    return devices(s, d).select("run", *(c.alias(n) for n, c in N.member_parts(path).items()))


@query("S10_run_dirs", f"select run, maker, model device, '.30' caliber, host cartridge, make_date(2024, 1, (1 + run % 9)::int) event_date from {DEVICES}")
def s10(s, d):
    x = paths(s, d).select("run", N.member_parts("path")["run_dir"].alias("dir"))
    x = x.select("run", *(c.alias(k) for k, c in N.run_dir_parts("dir").items()))
    return x.select("run", "maker", "device", "caliber", "cartridge", N.event_date("event").alias("event_date"))


@query("S11_capture_files", f"""select run, case run % 5 when 4 then null when 1 then ' Mil Left ' else 'Mil Left' end signal, case when run % 5 < 4 then 'ML' end mic, case run % 5 when 0 then 'x' when 2 then '12' when 4 then null else 'txt' end suffix, run % 5 = 0 excluded from {DEVICES}""")
def s11(s, d):
    k, head = F.col("run") % 5, F.lit("Time Group_Expanded Time(")
    name = F.concat(head, F.when(k == 1, " Mil Left ").otherwise("Mil Left"), F.lit(") - Input"), F.when(k == 0, ".x").when(k == 1, "").when(k == 2, ".12").when(k == 3, ".txt").otherwise(".y"))
    return devices(s, d).select("run", *(c.alias(n) for n, c in N.capture_file(name).items()))


@query("S12_spec_files", f"select case when run % 3 = 0 then 'Old ' else '' end || 'Specs.txt' path, run, model as name, nullif(weight, 11) length_in, price weight_oz, host caliber, 1.5::double max_diameter_in, case when run % 3 = 0 then 'Old' else '' end note from {DEVICES}")
def s12(s, d):
    text = F.concat_ws("\r\n", "model", F.when(F.col("weight") == 11, "n/a").otherwise(F.col("weight").cast("string")), F.col("price").cast("string"), "host", F.lit("1.5"))
    name = F.concat(F.when(F.col("run") % 3 == 0, "Old ").otherwise(""), F.lit("Specs.txt"))
    specs = captures.parse_specs(devices(s, d).select(F.concat("run", F.lit("/"), name).alias("path"), text.alias("text")))
    return specs.withColumns({"run": F.substring_index("path", "/", 1).cast("long"), "path": F.substring_index("path", "/", -1)})


@query("S13_file_kinds", f"select case run % 7 when 0 then 'capture' when 1 then 'specs' when 2 then 'ignored' when 3 then 'void' when 4 then 'note' when 5 then 'void' else 'unrecognised' end kind, count(*) n from {DEVICES} group by 1")
def s13(s, d):
    k = F.col("run") % 7
    name = F.when(k.isin(0, 3, 5), "Time Group_Expanded Time(Mil Left) - Input.3").when(k == 1, "DNR Specs.txt").when(k == 2, ".DS_Store").when(k == 4, "FIXME").otherwise(F.col("model"))
    folder = F.when(k == 3, "Day1/a/b/XX Shot 4").when(k == 5, "Day1/a/b/Shot 4 Did Not Record").otherwise("Day1/a/b/Shot 1")
    return devices(s, d).select(N.file_kind(name, folder).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("A11_observed_report", """with f as (select *, vec_id % 9 k from embeddings) select count(*) files, count(*) filter (k < 7) waveforms, (64 * count(*) filter (k < 7))::bigint samples, count(*) filter (k = 3) excluded, count(*) filter (k = 7) void, count(*) filter (k = 8) warnings,
    count(*) filter (k < 7 and label = 3) short_captures, 0::bigint truncated, count(*) filter (k < 7 and label = 4) defective, count(*) filter (k = 5) unknown_signals, count(*) filter (k < 7 and label = 3) || ' x 64' short_lengths from f""")
def a11_observed(s, d):
    """The report of an ingest, counted while its files are written."""
    k = F.col("path").cast("long") % 9
    parsed = captures.parse_captures(exports(s, d)).withColumns({"name": F.when(k == 8, "notes.doc").otherwise(F.concat(F.lit("Time Group_Expanded Time("), F.when(k == 5, "Far Side").otherwise("Mil Left"), F.lit(") - Input."), F.when(k == 3, "x").otherwise("txt"))), "folder": F.when(k == 7, "Day1/a/b/XX Shot 4").otherwise("Day1/a/b/Shot 1")})
    parsed = parsed.withColumns({"kind": N.file_kind("name", "folder"), **{c: N.capture_file("name")[c] for c in ("mic", "excluded")}})
    return V.ingest_observed(parsed, store.fresh_folder(s, "ingested"), "kind", "samples", F.col("excluded"), "mic", "short_capture", "truncated", "defects")


@query("S14_aliases", f"select run, host || '/Input.txt' target, maker || '/Input.5' alias from {DEVICES} where run % 2 = 0")
def s14(s, d):
    """A row for each link of a listing, beside the file it stands for; a popular file's aliases are rows, not one cell."""
    rows = devices(s, d)
    links = rows.where("run % 2 = 0").select("run", F.concat("host", F.lit("/Input.txt")).alias("target"), F.concat("maker", F.lit("/Input.5")).alias("alias"))
    return captures.link_aliases(links, rows.select(F.concat("host", F.lit("/Input.txt")).alias("path")).distinct())


@query("S15_load_years", "select year(o_orderdate)::int as year, count(*) n, round(sum(o_totalprice + case when year(o_orderdate) = 1996 then 1 else 0 end), 2) total from orders group by 1")
def s15(s, d):
    """Every year is loaded, then one is replaced; each load is a version."""
    from .registry import tests

    stored, rows = YearTable(s, store.fresh_folder(s, "years")), tests(s, d).select("run", "year", "value")
    stored.load(rows)
    stored.load(rows.where("year = 1996").withColumn("value", F.col("value") + 1), replace=True)
    return stored.read().groupBy("year").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("S15_earlier_version", "select year(o_orderdate)::int as year, count(*) n, round(sum(o_totalprice), 2) total from orders where year(o_orderdate) < 1999 group by 1")
def s15b(s, d):
    """What the table was before its last two loads."""
    from .registry import tests

    stored, rows = YearTable(s, store.fresh_folder(s, "years")), tests(s, d).select("run", "year", "value")
    first = stored.load(rows.where("year < 1999"))
    stored.load(rows.where("year >= 1999"))
    stored.load(rows.where("year = 1996").withColumn("value", F.lit(0.0)), replace=True)
    return stored.read(first).groupBy("year").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("S16_summary_only_runs", f"select run, run % 3 = 0 in_summary from {DEVICES}")
def s16(s, d):
    rows = devices(s, d).select("run", "maker")
    return store.with_unmatched(rows.where("run % 3 <> 0"), rows, "run").select("run", "in_summary")


@query("S17_view_export", f"{TABLES}, {VIEW_RUN} select test_run_id, manufacturer, waveform_count, round(se_peak_db, 7) se_peak_db from run_view")
def s17(s, d):
    path = store.fresh_folder(s, "export") + ".csv"
    view = V.v_run(stored(s, d))
    store.export(view, "v_run", path)
    names = {f.name: f.dataType.simpleString() for f in view.schema.fields}
    back = s.read.option("header", True).schema(", ".join(f"{k} {v}" for k, v in names.items())).csv(path)
    return rounded(back.select("test_run_id", "manufacturer", "waveform_count", "se_peak_db"), "se_peak_db", to=7)


@query("S18_sample_export", f"select id, round(0.001 + i * 0.000025, 9)::double time_s, round(p, 6) pressure_pa from {LONG}")
def s18(s, d):
    return rounded(store.sample_rows(records(s, d), "id", "samples", 0.001, DT).withColumn("time_s", F.round("time_s", 9)), "pressure_pa")


@query("S18_sample_arrays", f"select id, list(round(0.001 + i * 0.000025, 9)::double order by i) time_s, list(round(p, 6) order by i) pressure_pa from {LONG} group by id")
def s18b(s, d):
    out = store.sample_arrays(records(s, d), "id", "samples", 0.001, DT)
    return out.select("id", F.transform("time_s", lambda t: F.round(t, 9)).alias("time_s"), F.transform("pressure_pa", lambda p: F.round(p, 6)).alias("pressure_pa"))


@query("S07_header_fields", """select vec_id::varchar path, case when label % 4 = 0 then 51200.0 when label % 4 < 3 then 40000.0 end::double sample_rate_hz, case when label % 4 = 1 then 1 / 40000.0::double when label % 4 = 0 then 1 / 51200.0::double when label % 4 = 2 then 0.000025 end::double dt_s, -0.5::double t0_s, case when label % 2 = 0 then 316.2 end::double input_range, case when label % 3 = 0 then 0.00002 end::double db_reference, label % 5 = 0 overload,
    case when label % 4 < 2 then timestamp '2024-03-07 10:11:12.345' end captured_at from embeddings""")
def s07(s, d):
    """Rate and step each from the other where one is missing, fields that are not there, dates that are none."""
    label = F.col("label")
    rate = F.when(label % 4 == 0, F.lit("InputSampleFrequency:\t51200")).when(label % 4 == 1, F.lit("InputSampleFrequency:\t40000")).otherwise("InputSampleFrequency:\t n/a")
    step = F.when(label % 4 == 2, F.lit("X-Axis delta:\t2.5e-05")).otherwise("X-Axis delta:\t")
    lines = F.array(rate, step, F.lit("X-Axis first value:\t-0.5\t "), F.when(label % 2 == 0, F.lit("InputRange:\t316.2")).otherwise("InputRange:\tauto"), F.when(label % 3 == 0, F.lit("dBReference:\t2e-05")).otherwise("Comment:\tnone"), F.when(label % 4 < 2, F.lit("Date:\t3/7/2024")).otherwise("Date:\t31/31/2024"), F.lit("Time:\t10:11:12:345"), F.lit("1\t0\t 1.5"), F.lit("TagsBegin:"), F.when(label % 5 == 0, F.lit("OverLoad:\t \tTrue")).otherwise("OverLoad:\t \tFalse"), F.lit("TagsEnd:"))
    files_in = table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.array_join(lines, "\r\n").alias("text"))
    return captures.parse_captures(files_in).select("path", "sample_rate_hz", "dt_s", "t0_s", "input_range", "db_reference", "overload", "captured_at")


@query("S19_content_version")
def s19(s, d):
    return store.version(devices(s, d), ["run", "maker", "price"])


@query("S20_spectra")
def s20(s, d):
    return waveform.third_octaves(records(s, d), ["id"], "samples", DT).select("id", store.spectra_json(F.col("levels")).alias("spectrum"))


@query("S21_provenance")
def s21(s, d):
    return store.provenance(s, f"{d}/embeddings.parquet")


def streamed(s, d):
    """The records by a stream of one file a batch, run twice: the second run finds nothing new."""
    raw, target, progress = table(s, d, "embeddings"), store.fresh_folder(s, "landed"), store.fresh_folder(s, "progress")
    inbox = store.fresh_folder(s, "inbox")
    raw.repartition(3).write.parquet(inbox)
    stream = s.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(inbox).select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double") * 500).alias("samples"))
    sinks = {"metrics": ["id", "peak_pa", "peak_db"], "bands": ["id", "levels"]}
    for _ in range(2):
        incremental(s, stream, "id", lambda b: waveform.shot_metrics_and_bands(b, ["id"], "samples", WIDE_DT, -20, -6), sinks, target, progress, "inbox")
    return target


@query("R01_incremental_metrics", curves(f"(select * from {LONG} where i < 63)") + f" select id, round(peak_pa, 5) peak_pa, round({db('peak_pa')}, 4) peak_db from m")
def r01(s, d):
    return landed(s, streamed(s, d), "metrics").select("id", F.round("peak_pa", 5).alias("peak_pa"), F.round("peak_db", 4).alias("peak_db"))


DFT63 = f"(select id, k, (case when k = 0 then 1 else 2 end) * (pow(sum(p * cos(2 * pi() * k * i / 63)), 2) + pow(sum(p * sin(2 * pi() * k * i / 63)), 2)) / 3969 w from {LONG}, (select unnest(range(0, 32)) k) where i < 63 group by id, k)"


@query("R01_incremental_bands", f"""select id, b, round(10 * log10(sum(w) / 4e-10), 4) db from {DFT63} join (select b, 1000 * pow(10.0, b / 10.0) c from (select unnest(range(-20, -5)) b)) on k / (63 * {WIDE_DT}) >= c / pow(2, 1 / 6.0::double) and k / (63 * {WIDE_DT}) < c * pow(2, 1 / 6.0::double) group by id, b having sum(w) > 0""")
def r01b(s, d):
    """Third-octave levels, from the same pass and batches as the metrics."""
    x = landed(s, streamed(s, d), "bands").select("id", F.posexplode("levels").alias("b", "db")).where("db is not null")
    return x.select("id", (F.col("b") - 20).cast("long").alias("b"), F.round("db", 4).alias("db"))


CATALOGUE = f"""with st as (select run, mic, count(value) n, avg(value) mean, stddev_samp(value) / sqrt(count(value)) se from {SHOTS} where not excluded group by all)
    select p.run, maker || ' ' || model as name, host, round(max(mean) filter (mic = 'click'), 6) click, round(max(se) filter (mic = 'click'), 6) click_sem, round(max(mean) filter (mic = 'view'), 6) "view", rnk "rank" from (select *, row_number() over (partition by host order by price, run) rnk from {DEVICES}) p left join st using (run) group by p.run, maker, model, host, rnk"""


@query("X01_catalogue", CATALOGUE)
def x01(s, d):
    st = statistics.run_statistics(shots(s, d), ["run", "mic"])
    pick = lambda mic, c: F.max(F.when(F.col("mic") == mic, F.col(c)))
    wide = st.groupBy("run").agg(pick("click", "mean").alias("click"), pick("click", "sem").alias("click_sem"), pick("view", "mean").alias("view"))
    runs = ranking.rank_order(devices(s, d), ["host"], "price", "run")
    out = runs.join(wide, "run", "left").select("run", N.full_name("maker", "model").alias("name"), "host", "click", "click_sem", "view", "rank")
    return rounded(out, "click", "click_sem", "view")


@query("X02_shot_table", f"select event_id, run, mic, shot, value from {SHOTS} where not excluded")
def x02(s, d):
    return shots(s, d).where("not excluded").select("event_id", "run", "mic", "shot", "value")


@query("X03_waveform_index", """select vec_id id, 40 envelope_bytes, (coalesce(sum(20 + len(embedding) * 2) over (order by vec_id rows between unbounded preceding and 1 preceding), 0))::bigint "offset", 20 + len(embedding) * 2 frame_bytes from embeddings""")
def x03(s, d):
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit(40).alias("envelope_bytes"), (20 + F.size("embedding") * 2).cast("long").alias("frame_bytes"))
    return prefix_sums(rows, "id", {"frame_bytes": "offset"})
