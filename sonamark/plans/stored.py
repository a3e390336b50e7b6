"""Queries of the views, the catalogue and what reads them. The stored tables are bound to customer (runs), events (waveforms and shots), embeddings (bands)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import levels as L
from ..operators import views as V
from .registry import query, rounded, table

MIC = {"view": "SE", "click": "ML", "purchase": "MR", "signup": "225"}
SHOT = {"peak_pa": "value", "peak_db": "100 + value / 10", "peak_dba": "90 + value / 10", "impulse_pa_ms": "value / 2", "impulse_db_ms": "80 + value / 20", "peak_leq10ms_dba": "85 + value / 7"}
PUBLISHED = dict(zip(V.METRICS, [SHOT[k] for k in ("peak_pa", "peak_db", "peak_dba", "impulse_pa_ms", "impulse_db_ms", "peak_leq10ms_dba")]))
RUN = {
    "id": "c_custkey", "dataset_id": "20 + c_nationkey % 5", "event_label": "'Day' || (c_custkey % 3 + 1)", "event_date": "cast(null as date)", "manufacturer": "'Maker ' || (c_custkey % 25)",
    "suppressor": "'Can ' || (c_custkey % 40)", "caliber": "case c_custkey % 3 when 0 then '.30' when 1 then '.22' else '9mm' end", "cartridge": "c_mktsegment", "is_baseline": "c_custkey % 17 = 0",
    "shots": "5", "weight_oz": "c_acctbal", "length_in": "cast(c_nationkey as double)", "max_diameter_in": "cast(1.5 as double)",
}
MIC_SQL = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in MIC.items()) + " end"
HOSTS = [("AUTOMOBILE", "Auto", 16.0, 110.0, "gas", "AR-15", True), ("BUILDING", "Build", 20.0, None, "bolt", None, False), ("MACHINERY", "Mach", None, None, None, None, None)]
CAVEATS = [(2021, "BUILDING", ["SE"], "ignore", "wind"), (2021, "BUILDING", ["ML"], "note", "echo"), (2023, "AUTOMOBILE", ["SE", "MR"], "note", "harmonic")]
HOST_KIND = "cartridge string, label string, barrel_in double, grains double, cycling string, platform string, subsonic boolean"


def stored(s, d) -> V.Store:
    e = table(s, d, "events").withColumns({"mic": F.expr(MIC_SQL), "shot": F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")).cast("long")})
    published = table(s, d, "events").select(F.col("user_id").alias("test_run_id"), F.expr(MIC_SQL).alias("mic"), "value").where("mic is not null").groupBy("test_run_id", "mic")
    return V.Store(
        dataset=table(s, d, "nation").selectExpr("20 + n_nationkey % 5 id", "2020 + n_nationkey % 5 year").distinct(),
        test_run=table(s, d, "customer").selectExpr(*(f"{v} {k}" for k, v in RUN.items())),
        summary_metric=published.agg(*(F.avg(F.expr(v)).alias(k) for k, v in PUBLISHED.items())),
        waveform=e.select(F.col("event_id").alias("id"), F.col("user_id").alias("test_run_id"), "mic", "shot", (F.col("event_id") % 11 == 0).alias("excluded"), F.col("ts").alias("captured_at"), (F.col("value") > 300).alias("overload")),
        shot_metric=table(s, d, "events").where("event_id % 13 <> 0").selectExpr("event_id waveform_id", *(f"{v} {k}" for k, v in SHOT.items())),
        band_level=table(s, d, "embeddings").select(F.col("vec_id").alias("waveform_id"), F.transform("embedding", lambda x: x.cast("double") * 100).alias("levels")),
    )


TABLES = f"""with dataset as (select distinct 20 + n_nationkey % 5 id, 2020 + n_nationkey % 5 as year from nation), test_run as (select {", ".join(f"{v} {k}" for k, v in RUN.items())} from customer),
    summary_metric as (select user_id test_run_id, {MIC_SQL} mic, {", ".join(f"avg({v}) {k}" for k, v in PUBLISHED.items())} from events group by all having mic is not null),
    waveform as (select event_id id, user_id test_run_id, {MIC_SQL} mic, row_number() over (partition by user_id, event_type order by ts, event_id) shot, event_id % 11 = 0 excluded, ts captured_at, value > 300 overload from events),
    shot_metric as (select event_id waveform_id, {", ".join(f"{v} {k}" for k, v in SHOT.items())} from events where event_id % 13 <> 0),
    runs as (select d.year, r.* exclude (dataset_id) from test_run r join dataset d on d.id = r.dataset_id),
    measurement as (select r.* exclude (id), r.id test_run_id, m.* exclude (test_run_id) from runs r join summary_metric m on m.test_run_id = r.id),
    shot as (select r.year, r.id test_run_id, w.id waveform_id, r.event_label, r.manufacturer, r.suppressor, r.caliber, r.cartridge, w.mic, w.shot, w.excluded, w.captured_at, w.overload, s.* exclude (waveform_id) from waveform w join shot_metric s on s.waveform_id = w.id join runs r on r.id = w.test_run_id)"""
SIDE = {f"{p}_{m}": (mic, m) for mic, (p, ms) in V.PIVOT.items() for m in ms}
VIEW_RUN = f"""run_view as (select r.* exclude (id), r.id test_run_id, 0.785::double * max_diameter_in * max_diameter_in * length_in vol_cuin, {", ".join(f"{p}.{m} {p}_{m}" for p, ms in V.PIVOT.values() for m in ms)}, (select count(*) from waveform w where w.test_run_id = r.id) waveform_count
    from runs r {" ".join(f"left join summary_metric {p} on {p}.test_run_id = r.id and {p}.mic = '{mic}'" for mic, (p, _) in V.PIVOT.items())})"""
DOUBLES = [*SIDE, "vol_cuin"]


def listed(names) -> str:
    return ", ".join(f"round({x}, 7) {x}" for x in names)


@query("J01_v_measurement", f"{TABLES} select * exclude ({', '.join(V.METRICS)}), {listed(V.METRICS)} from measurement")
def j01(s, d):
    return rounded(V.v_measurement(stored(s, d)), *V.METRICS, to=7)


@query("J02_v_run", f"{TABLES}, {VIEW_RUN} select * exclude ({', '.join(DOUBLES)}), {listed(DOUBLES)} from run_view")
def j02(s, d):
    return rounded(V.v_run(stored(s, d)), *DOUBLES, to=7)


@query("J03_v_shot", f"{TABLES} select * exclude ({', '.join(SHOT)}), {listed(SHOT)} from shot")
def j03(s, d):
    return rounded(V.v_shot(stored(s, d)), *SHOT, to=7)


@query("F01_runs_of_view", f"{TABLES}, {VIEW_RUN} select year, test_run_id, suppressor from run_view where manufacturer = 'Maker 3' and caliber = '.30'")
def f01(s, d):
    return V.runs(V.v_run(stored(s, d)), manufacturer="Maker 3", caliber=".30", cartridge=None).select("year", "test_run_id", "suppressor")


@query("F02_waveforms_of_run", f"{TABLES} select id, mic, shot from waveform where test_run_id = 7 and mic = 'SE'")
def f02(s, d):
    return V.waveforms(stored(s, d).waveform, 7, "SE").select("id", "mic", "shot")


@query("F03_index_of_runs", f"{TABLES} select w.id waveform_id, w.test_run_id, w.shot, r.year from waveform w join runs r on r.id = w.test_run_id where r.cartridge = 'BUILDING'")
def f03(s, d):
    return V.waveform_index(stored(s, d), cartridge="BUILDING").select("waveform_id", "test_run_id", "shot", "year")


@query("J08_todo_of_year", f"{TABLES} select w.id waveform_id from waveform w join runs r on r.id = w.test_run_id where r.year = 2022 and w.id not in (select waveform_id from shot_metric)")
def j08(s, d):
    db = stored(s, d)
    return V.todo(db, db.shot_metric, 2022)


@query("J13_published_with_waveforms", f"{TABLES} select id from test_run where exists (select 1 from waveform w where w.test_run_id = test_run.id) and exists (select 1 from summary_metric m where m.test_run_id = test_run.id)")
def j13(s, d):
    return V.with_waveforms(stored(s, d)).select("id")


SEM = {f"{c}_sem": (mic, m) for c, (mic, m) in SIDE.items()}
POP = {"se_first_round_pop": "SE", "ml_first_round_pop": "ML"}
REDUCTION = {f"{p}_reduction_{n}": (p.upper(), m) for p in ("se", "ml") for n, m in (("dba", "peak_dba"), ("db", "peak_db"))}
BAND = {"se_low_freq_db": ("SE", "low_db"), "ml_low_freq_db": ("ML", "low_db"), "se_centroid_hz": ("SE", "centroid")}
HOST_SQL = "(values " + ", ".join(f"('{c}', {b or 'null'}::double, {g or 'null'}::double, {repr(y) if y else 'null'}, {repr(p) if p else 'null'}, {'null' if u is None else repr('subsonic' if u else 'supersonic')})" for c, _, b, g, y, p, u in HOSTS) + ") h(cartridge, host_barrel_in, host_grains, host_cycling, host_platform, host_ammo)"
CATALOGUE = f"""{TABLES}, {VIEW_RUN},
    st as (select test_run_id, mic, {", ".join(f"case when count({m}) > 1 then stddev_samp({m}) / sqrt(count({m})) end {m}_sem" for m in ("peak_db", "peak_dba", "impulse_db_ms", "peak_leq10ms_dba"))}, case when min(shot) = 1 and count(*) > 1 then arg_min(peak_dba, shot) - (sum(peak_dba) - arg_min(peak_dba, shot)) / (count(*) - 1) end pop from shot where not excluded group by 1, 2),
    base as (select year, cartridge, mic, {", ".join(f"arg_max({m}, test_run_id) b_{m}" for m in ("peak_dba", "peak_db"))} from measurement where is_baseline group by all),
    red as (select test_run_id, mic, {", ".join(f"b_{m} - {m} {m}" for m in ("peak_dba", "peak_db"))} from measurement join base using (year, cartridge, mic) where not is_baseline),
    lv as (select vec_id waveform_id, unnest(range(0, 64)) k, unnest(embedding)::double * 100 l from embeddings), pw as (select test_run_id, mic, 1000 * pow(10.0, (k - 40) / 10.0) c, avg(pow(10.0, l / 10)) p from waveform w join lv on lv.waveform_id = w.id where not excluded group by all),
    bd as (select test_run_id, mic, 10 * log10(sum(p) filter (c <= 250)) low_db, sum(c * p) / sum(p) centroid from pw group by 1, 2)
    select v.year, v.test_run_id, v.cartridge, waveform_count, {listed(DOUBLES)},
        {", ".join(f"(select round({m}_sem, 7) from st where st.test_run_id = v.test_run_id and st.mic = '{mic}') {c}" for c, (mic, m) in SEM.items())},
        {", ".join(f"(select round(pop, 7) from st where st.test_run_id = v.test_run_id and st.mic = '{mic}') {c}" for c, mic in POP.items())},
        {", ".join(f"(select round({m}, 7) from red where red.test_run_id = v.test_run_id and red.mic = '{mic}') {c}" for c, (mic, m) in REDUCTION.items())},
        {", ".join(f"(select round({m}, 3) from bd where bd.test_run_id = v.test_run_id and bd.mic = '{mic}') {c}" for c, (mic, m) in BAND.items())},
        host_barrel_in, host_grains, host_cycling, host_platform, host_ammo, case when year = 2021 and v.cartridge = 'BUILDING' then 'echo; wind' when year = 2023 and v.cartridge = 'AUTOMOBILE' then 'harmonic' end caveat,
        replace(lower(manufacturer), ' ', '-') || '/' || replace(lower(suppressor), ' ', '') can
    from run_view v left join {HOST_SQL} on h.cartridge = v.cartridge"""


def curated(s):
    return s.createDataFrame(HOSTS, HOST_KIND), s.createDataFrame(CAVEATS, "year int, cartridge string, mics array<string>, severity string, summary string")


@query("X01_run_catalogue", CATALOGUE)
def x01(s, d):
    out = V.catalogue(stored(s, d), *curated(s), L.centres(-40, 23))
    out = rounded(rounded(out, *DOUBLES, *SEM, *POP, *REDUCTION, to=7), *BAND, to=3)
    return out.select("year", "test_run_id", "cartridge", "waveform_count", *DOUBLES, *SEM, *POP, *REDUCTION, *BAND, "host_barrel_in", "host_grains", "host_cycling", "host_platform", "host_ammo", "caveat", "can")


@query("X02_shot_export", f"{TABLES} select waveform_id, test_run_id, mic, shot, {listed(list(SHOT)[1:3] + list(SHOT)[4:])} from shot")
def x02(s, d):
    names = list(SHOT)[1:3] + list(SHOT)[4:]
    return rounded(V.v_shot(stored(s, d)), *names, to=7).select("waveform_id", "test_run_id", "mic", "shot", *names)


@query("C08_mask_of_shots", f"{TABLES} select waveform_id, case when year = 2021 and cartridge = 'BUILDING' then case mic when 'SE' then 'ignore' when 'ML' then 'note' end when year = 2023 and cartridge = 'AUTOMOBILE' and mic in ('SE', 'MR') then 'note' end severity from shot")
def c08(s, d):
    return V.caveat_mask(V.v_shot(stored(s, d)), curated(s)[1]).select("waveform_id", "severity")


@query("A15_host_tiers_all", f"""{TABLES}, own as (select cartridge || case when id % 3 = 0 then '' else (id % 40)::varchar end host, year, is_baseline from runs), g as (select host, count(*) runs, list_sort(list(distinct year)) as years from own where not is_baseline group by 1),
    x as (select *, case when starts_with(host, 'BUILDING') and len(years) = 1 then 'BUILDING (2021)' else host end label, case when len(years) > 1 then 'regular' when years[1] = 2021 then 'first' else 'other' end tier from g),
    o as (select regexp_replace(label, ' .2021.$', '') label, min(host) earlier, arg_min(runs, host) earlier_runs from x where tier = 'first' and label like '% (2021)' group by 1)
    select x.host, x.label, runs, years, tier, runs >= 4 rankable, row_number() over (partition by tier order by runs desc, label, x.host) place, case when x.label <> x.host then 'one year only' end description, case when tier = 'regular' then earlier end earlier, case when tier = 'regular' then earlier_runs end earlier_runs from x left join o using (label)""")
def a15(s, d):
    rows = V.runs_by_year(stored(s, d)).withColumn("host", F.concat("cartridge", F.when(F.col("test_run_id") % 3 == 0, "").otherwise((F.col("test_run_id") % 40).cast("string"))))
    single = rows.where("not is_baseline").groupBy("host").agg(F.countDistinct("year").alias("n")).where("n = 1 and startswith(host, 'BUILDING')")
    return V.host_tiers(rows, "host", "year", "is_baseline", single.select("host", F.lit("BUILDING (2021)").alias("label"), F.lit("one year only").alias("description")), 2021)


@query("A23_mics_in_order", f"{TABLES} select test_run_id, list(mic order by case mic when 'SE' then 1 when 'ML' then 2 when 'MR' then 3 else 4 end) mics from (select distinct test_run_id, mic from waveform where mic is not null) group by 1")
def a23(s, d):
    return V.mics_of_run(stored(s, d).waveform, "test_run_id", "mic")


@query("A09_makers", f"""{TABLES}, b as (select manufacturer, year, count(distinct caliber) n from runs group by all)
    select manufacturer, count(distinct suppressor) models, list_sort(list(distinct year)) as years, list_sort(list(distinct caliber)) bores, (select string_agg(year || ':' || n, ',' order by year) from b where b.manufacturer = runs.manufacturer) bores_by_year from runs group by manufacturer""")
def a09(s, d):
    out = V.maker_catalogue(V.runs_by_year(stored(s, d)), "manufacturer", "suppressor", "year", "caliber")
    return out.withColumn("bores_by_year", F.array_join(F.transform(F.array_sort(F.map_entries("bores_by_year")), lambda x: F.concat_ws(":", x["key"], x["value"])), ","))


@query("C04_settled_names", f"""{TABLES}, k as (select *, case when id % 5 = 0 then upper(suppressor) else suppressor end spelled from runs), c as (select manufacturer, lower(spelled) as key, spelled, count(*) n, max(year) y, min(id) f from k group by all),
    b as (select manufacturer, key, arg_max(spelled, (n, y, -f)) shown from c group by all) select id test_run_id, k.manufacturer || ' ' || shown full_name from k join b on b.manufacturer = k.manufacturer and b.key = lower(spelled)""")
def c04(s, d):
    rows = V.runs_by_year(stored(s, d)).withColumn("suppressor", F.when(F.col("test_run_id") % 5 == 0, F.upper("suppressor")).otherwise(F.col("suppressor")))
    return V.settled_names(rows, "manufacturer", "suppressor", "year", "test_run_id").select("test_run_id", "full_name")


#: Doubles printed to two places: a double that is a multiple of an eighth may be an exact half of a hundredth, and goes up; others are printed by their exact value.
SHOWN = "case when a * 8 = floor(a * 8) then printf('%.2f', floor(a * 100 + 0.5) / 100) else printf('%.2f', a) end"


@query("C14_display_numbers", f"""with t as (select event_id, case event_id % 8 when 0 then null when 1 then -0.001::double when 2 then (event_id % 4001) / 1000.0::double + 0.005::double when 3 then (event_id % 500) / 8.0::double - 30 when 4 then 1.005::double when 5 then -2.675::double else value - 40 end x from events), u as (select *, abs(x) a from t)
    select event_id, case when x is null then '—' when ({SHOWN})::double = 0 then {SHOWN} when x < 0 then '−' || ({SHOWN}) else '+' || ({SHOWN}) end as text from u""")
def c14(s, d):
    """Ties of decimals that doubles miss, exact halves, what is printed as zero, and missing values."""
    k, e = F.col("event_id") % 8, F.col("event_id")
    x = F.when(k == 0, None).when(k == 1, -0.001).when(k == 2, (e % 4001) / 1000.0 + 0.005).when(k == 3, (e % 500) / 8.0 - 30).when(k == 4, 1.005).when(k == 5, -2.675).otherwise(F.col("value") - 40)
    return table(s, d, "events").select("event_id", V.display_number(x, 2, sign=True).alias("text"))


@query("C17_error_bars_all", f"""{TABLES}, b as (select waveform_id, peak_db - case when waveform_id % 4 = 0 then 0 else 0.5 end lo, peak_db + case when waveform_id % 4 = 0 then 0 else 0.5 end hi from shot)
    select waveform_id, round(lo, 4) lo, round(hi, 4) hi, round((select min(lo) - 0.05 * (max(hi) - min(lo)) from b), 4) "from", round((select max(hi) + 0.05 * (max(hi) - min(lo)) from b), 4) "to" from b""")
def c17(s, d):
    rows = V.v_shot(stored(s, d)).withColumn("sem", F.when(F.col("waveform_id") % 4 != 0, 0.5))
    return rounded(V.error_bars(rows, "peak_db", "sem"), "lo", "hi", "from", "to", to=4).select("waveform_id", "lo", "hi", "from", "to")


COMPARED = {"se_peak_dba": "min", "se_peak_db": "min", "se_impulse_db_ms": "min", "se_peak_leq10ms_dba": "min", "ml_peak_dba": "min", "ml_peak_db": "min", "ml_impulse_db_ms": "min", "ml_peak_leq10ms_dba": "min", "weight_oz": "min", "waveform_count": "max"}


@query("K07_compared_runs", f"""{TABLES}, {VIEW_RUN}, r as (select * from run_view where test_run_id in (1, 2, 3, 4)), u as ({" union all ".join(f"select '{m}' measure, test_run_id run, {m}::double as value, '{b}' better from r" for m, b in COMPARED.items())}),
    t as (select measure, count(value) n, case any_value(better) when 'min' then min(value) else max(value) end top from u group by 1)
    select measure, run, round(value, 7) as value, coalesce((select count(distinct cartridge) from r) = 1 and n >= 2 and value = top, false) best, (select count(distinct cartridge) from r) > 1 mixed_hosts, (select count(distinct year) from r) > 1 mixed_years from u join t using (measure)""")
def k07(s, d):
    some = V.v_run(stored(s, d)).where(F.col("test_run_id").isin(1, 2, 3, 4))
    return rounded(V.compared(some, "test_run_id", "cartridge", "year", COMPARED), "value", to=7)


@query("W12_scored_string", f"{TABLES}, f as (select test_run_id, 2 + test_run_id % 3 shot from (select distinct test_run_id from waveform)) select w.id, w.test_run_id, w.mic, w.shot from waveform w join f using (test_run_id) where not excluded and w.shot >= f.shot")
def w12(s, d):
    w = stored(s, d).waveform
    start = w.select("test_run_id").distinct().select("test_run_id", (2 + F.col("test_run_id") % 3).alias("shot"))
    return V.scored_string(w, "test_run_id", "shot", "excluded", start).select("id", "test_run_id", "mic", "shot")


@query("K03_search_of_devices", f"""{TABLES} select manufacturer, suppressor, count(*) runs, starts_with(lower(suppressor), 'can') or starts_with(lower(suppressor), '1') prefix from runs where not is_baseline and contains(lower(manufacturer || ' ' || suppressor), 'can') and contains(lower(manufacturer || ' ' || suppressor), '1') group by all order by prefix desc, runs desc, suppressor, manufacturer limit 8""")
def k03(s, d):
    return V.device_search(V.runs_by_year(stored(s, d)), "Can 1", "manufacturer", "suppressor", "is_baseline")


@query("K07_compared_on_one_host", f"""{TABLES}, {VIEW_RUN}, r as (select * from run_view where cartridge = 'BUILDING' order by test_run_id limit 4), u as ({" union all ".join(f"select '{m}' measure, test_run_id run, {m}::double as value, '{b}' better from r" for m, b in COMPARED.items())}),
    t as (select measure, count(value) n, case any_value(better) when 'min' then min(value) else max(value) end top from u group by 1)
    select measure, run, round(value, 7) as value, coalesce(n >= 2 and value = top, false) best, false mixed_hosts, (select count(distinct year) from r) > 1 mixed_years from u join t using (measure)""")
def k07b(s, d):
    some = V.v_run(stored(s, d)).where("cartridge = 'BUILDING'").orderBy("test_run_id").limit(4)
    return rounded(V.compared(some, "test_run_id", "cartridge", "year", COMPARED), "value", to=7)


@query("S19_published_catalogue", f"{TABLES}, {VIEW_RUN} select test_run_id, year, manufacturer, waveform_count from run_view")
def s19(s, d):
    """The run view written under its version twice, once with its rows dealt otherwise, and read back from the one folder."""
    from ..sources import store

    view, folder = V.v_run(stored(s, d)), store.fresh_folder(s, "published")
    names = ["test_run_id", "year", "manufacturer", "waveform_count"]
    first = store.publish(view, folder, "v_run", names)
    second = store.publish(view.repartition(3), folder, "v_run", names)
    if first != second:
        raise ValueError("the version depends on how rows are dealt")
    return s.read.parquet(f"{folder}/v_run-{first}").select(*names)


@query("S20_spectra_of_runs", f"""{TABLES}, lv as (select vec_id waveform_id, unnest(range(0, 64)) k, unnest(embedding)::double * 100 l from embeddings), pw as (select test_run_id run, mic, k, avg(pow(10.0, l / 10)) p from waveform w join lv on lv.waveform_id = w.id where not excluded and mic is not null group by all)
    select run, mic, k i, round(10 * log10(p), 1)::double + 0.0::double as level from pw""")
def s20(s, d):
    """One object for each run, written as JSON and taken apart again."""
    from ..operators import statistics
    from ..sources import store

    db = stored(s, d)
    waves = db.waveform.where(~F.col("excluded")).select(F.col("id").alias("waveform_id"), F.col("test_run_id").alias("run"), "mic")
    spectra = statistics.band_statistics(waves.join(db.band_level, "waveform_id"), ["run", "mic"], "levels", L.centres(-40, 23))
    out = store.spectra_of_runs(spectra, "run", "mic", "spectrum").select("run", F.explode(F.from_json("spectra", "map<string,array<double>>")).alias("mic", "levels"))
    return out.select("run", "mic", F.posexplode("levels").alias("i", "level")).withColumn("i", F.col("i").cast("long"))


HOST_TABLE = "select n_name cartridge, 'L' || (n_nationkey % 20) label, case when n_nationkey % 3 = 0 then 16 end barrel_in, case when n_nationkey % 4 = 0 then 'report' end barrel_source, case n_nationkey % 5 when 0 then 'gas' when 1 then 'steam' end cycling, case when n_nationkey % 7 = 0 then 'AK' else 'AR' end platform from nation"
ALIAS_TABLE = "select 'a' || n_nationkey alias, case when n_nationkey % 6 = 0 then 'a' || cast(floor(n_nationkey / 2) as int) else 'M' end maker from nation"


@query("A24_violations", f"""with h as ({HOST_TABLE}), a as ({ALIAS_TABLE}) select 'caveat of an unknown host' violation, r_name as key from region where r_name not in (select cartridge from h)
    union select 'alias of an alias', alias from a where maker in (select alias from a) union select 'unknown cycling', cartridge from h where cycling = 'steam' union select 'unknown platform', cartridge from h where platform = 'AK'
    union select 'barrel and source differ', cartridge from h where (barrel_in is null) <> (barrel_source is null) union select 'label of several hosts', label from h group by label having count(*) > 1
    union select 'defect of an unknown run', s_name || '?' from supplier where s_suppkey % 10 = 0""")
def a24(s, d):
    from .registry import tables_as_views

    tables_as_views(s, d, "nation", "region", "supplier")
    hosts, aliases = s.sql(HOST_TABLE), s.sql(ALIAS_TABLE)
    runs = table(s, d, "supplier").select(F.col("s_name").alias("run"))
    defects = table(s, d, "supplier").select(F.concat("s_name", F.when(F.col("s_suppkey") % 10 == 0, "?").otherwise("")).alias("run"))
    return V.violations(hosts, table(s, d, "region").select(F.col("r_name").alias("cartridge")), aliases, defects, runs, ["gas"], ["AR"])
