"""Queries of the relational operators: filters, joins, statistics, windows, ranks, sets, names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import levels as L
from ..functions import names as N
from ..operators import filters, matching, numbering, offsets, ranking, statistics, views
from ..sources import store
from ..sources.versions import YearTable
from .registry import DEVICES, SHOTS, TESTS, devices, query, rounded, shots, table, tests


@query("A01_run_statistics", f"""with g as (select run, mic, count(value) n, avg(value) mean, stddev_samp(value) sd, min(shot) f, arg_min(value, shot) v, sum(value) t from {SHOTS} where not excluded group by all)
    select run, mic, n, round(mean, 6) mean, round(sd, 6) sd, round(sd / sqrt(n), 6) sem, round(case when f = 1 and n >= 2 then v - (t - v) / (n - 1) end, 6) pop from g""")
def a01(s, d):
    return rounded(statistics.run_statistics(shots(s, d), ["run", "mic"]), "mean", "sd", "sem", "pop")


@query("A02_first_round_pop", f"""with g as (select run, mic, count(*) n, min(shot) f, arg_min(value, shot) v, sum(value) t from {SHOTS} where not excluded group by all)
    select run, mic, round(v - (t - v) / (n - 1), 6) pop from g where f = 1 and n >= 2""")
def a02(s, d):
    return rounded(statistics.run_statistics(shots(s, d), ["run", "mic"]).where("pop is not null").select("run", "mic", "pop"), "pop")


@query("A03_linear_averages", f"""select run, mic, round(case when avg(value) > 0 then 20 * log10(avg(value) / 2e-5) end, 6) value_db, round(case when avg(value * 2) > 0 then 20 * log10(avg(value * 2) / 2e-5) end, 6) twice_db from {SHOTS} where not excluded group by all""")
def a03(s, d):
    rows = shots(s, d).where("not excluded").withColumn("twice", F.col("value") * 2)
    return rounded(statistics.linear_levels(rows, ["run", "mic"], ["value", "twice"]), "value_db", "twice_db")


@query("A05_coverage_by_year", f"""select year, count(*) runs, count(distinct host) hosts, count(distinct client) clients, count(distinct (host, client)) pairs from {TESTS} group by 1""")
def a05(s, d):
    return views.coverage(tests(s, d), "year", {"hosts": ["host"], "clients": ["client"], "pairs": ["host", "client"]})


@query("A06_waveform_coverage", f"""select year, count(distinct l_orderkey) runs, count(l_orderkey) waveforms, round(coalesce(sum(l_quantity), 0), 2) samples from {TESTS} t left join lineitem on l_orderkey = run group by 1""")
def a06(s, d):
    li = table(s, d, "lineitem").withColumnRenamed("l_orderkey", "run")
    return rounded(views.waveform_coverage(tests(s, d), li, "year", "run", "l_quantity"), "samples", to=2)


@query("A07_caliber_by_year", """select p_type host, count(*) filter (p_size < 20) small, count(*) filter (p_size >= 20 and p_size < 35) medium, count(*) filter (p_size >= 35) large, count(*) total from part group by 1""")
def a07(s, d):
    rows = devices(s, d).withColumn("class", F.when(F.col("weight") < 20, "small").when(F.col("weight") < 35, "medium").otherwise("large"))
    return statistics.crosstab(rows, "host", "class", ["small", "medium", "large"])


@query("A08_host_by_year", f"""select host, year, count(*) n, (select count(*) from {TESTS} u where u.host = t.host) total from {TESTS} t group by all""")
def a08(s, d):
    return views.counts_by(tests(s, d), "host", "year")


@query("A08_runs_by_host_and_year", f"""select host, year, count(*) runs from {TESTS} group by all""")
def a08_all(s, d):
    return tests(s, d).groupBy("host", "year").agg(F.count("*").alias("runs"))


@query("A09_maker_catalogue", f"""select maker, count(distinct model) models, list_sort(list(distinct host)) hosts, min(weight) lightest from {DEVICES} group by 1""")
def a09(s, d):
    return devices(s, d).groupBy("maker").agg(F.countDistinct("model").alias("models"), F.array_sort(F.collect_set("host")).alias("hosts"), F.min("weight").alias("lightest"))


@query("A08_hosts_described", f"""with h as (select * from (values ('1-URGENT', 'Urgent', 'goes first', 'rush'), ('5-LOW', 'Low', null, 'slow')) h(host, label, description, kind)), n as (select host, year, count(*) n from {TESTS} group by all)
    select n.host, n.year, n.n, sum(n.n) over (partition by n.host)::bigint total, coalesce(label, n.host) label, description, kind from n left join h using (host)""")
def a08_described(s, d):
    """Runs by host and year under the host's label, with its description and kind."""
    known = s.createDataFrame([("1-URGENT", "Urgent", "goes first", "rush"), ("5-LOW", "Low", None, "slow")], "host string, label string, description string, kind string")
    return views.with_hosts(views.counts_by(tests(s, d), "host", "year"), known, "host", "label")


@query("A10_dataset_totals", f"""with w as (select l_orderkey run, count(*) n, sum(l_quantity) s from lineitem group by 1) select year, count(*) runs, count(*) filter (not is_baseline) published, coalesce(sum(n), 0)::bigint waveforms, round(coalesce(sum(s), 0), 2) samples from {TESTS} t left join w using (run) group by 1""")
def a10_totals(s, d):
    """Runs, published ones, waveforms and their samples of each year."""
    waves = table(s, d, "lineitem").withColumnRenamed("l_orderkey", "run")
    return rounded(views.dataset_totals(tests(s, d), waves, "year", "run", ~F.col("is_baseline"), "l_quantity"), "samples", to=2)


@query("A22_attribute_categories", f"""with r as (select nullif(host, 'PROMO') host, maker, case when weight > 25 then true when weight > 10 then false end heavy from {DEVICES})
    {" union all ".join(f"select '{c}' attribute, {c}::varchar category, count(*) n, (select count({c}) from r) known from r where {c} is not null group by {c}" for c in ("host", "maker", "heavy"))}""")
def a22_categories(s, d):
    """How many runs know each attribute, and how many are of each of its categories."""
    rows = devices(s, d).select(F.when(F.col("host") != "PROMO", F.col("host")).alias("host"), "maker", F.when(F.col("weight") > 25, True).when(F.col("weight") > 10, False).alias("heavy"))
    return views.attribute_categories(rows, ["host", "maker", "heavy"])


@query("A10_dataset_info", f"""select year, count(*) runs, count(*) filter (not is_baseline) published, round(sum(value), 2) total from {TESTS} group by 1""")
def a10(s, d):
    return rounded(views.dataset_info(tests(s, d), "year", ~F.col("is_baseline"), "value"), "total", to=2)


@query("A11_ingest_report", """select event_type kind, count(*) n, count(*) filter (event_id % 11 = 0) excluded, count(distinct user_id) runs from events group by 1""")
def a11(s, d):
    return views.ingest_report(shots(s, d), "mic", F.col("excluded"), "run")


@query("A12_facet_counts", f"""select host, 'maker' facet, maker as value, count(*) n from {DEVICES} group by all union all select host, 'model', model, count(*) from {DEVICES} group by all""")
def a12(s, d):
    return views.facet_counts(devices(s, d), "host", ["maker", "model"])


@query("A13_extent", f"""select host, min(price) lo, max(price) hi from {DEVICES} group by 1""")
def a13(s, d):
    return statistics.extent(devices(s, d), "price", ("host",))


@query("A14_years", f"""select host, list_sort(list(distinct year)) as years, max(year) - min(year) span from {TESTS} group by 1""")
def a14(s, d):
    return views.years_of(tests(s, d), "host", "year")


@query("A15_host_tiers", f"""select client, count(*) runs, count(distinct year) as years, case when count(distinct year) > 1 then 'regular' when min(year) = 1995 then 'first year' else 'other' end tier, count(*) >= 4 rankable from {TESTS} group by 1""")
def a15(s, d):
    g = tests(s, d).groupBy("client").agg(F.count("*").alias("runs"), F.countDistinct("year").alias("years"), F.min("year").alias("y"))
    return g.select("client", "runs", "years", F.when(F.col("years") > 1, "regular").when(F.col("y") == 1995, "first year").otherwise("other").alias("tier"), (F.col("runs") >= 4).alias("rankable"))


@query("A16_display_names", f"""with g as (select lower(host) || '/' || maker as key, model, count(*) n, max(weight) y, min(run) f from {DEVICES} group by all)
    select key, model display_name from (select *, row_number() over (partition by key order by n desc, y desc, f) r from g) where r = 1""")
def a16(s, d):
    rows = devices(s, d).withColumn("key", F.concat_ws("/", F.lower("host"), "maker"))
    return N.display_names(rows, ["key"], "model", "weight", "run")


VERIFIED = {"price": ("l_extendedprice", 2), "qty": ("l_quantity", 1), "tax": ("l_tax", 3)}


@query("A17_verify", f"""with f as (select l_partkey k, l_returnflag f, {", ".join(f"avg({c}) {n}" for n, (c, _) in VERIFIED.items())} from lineitem where l_linenumber <= 5 group by all),
    p as (select l_partkey k, l_returnflag f, {", ".join(f"round(avg({c}), {r}) + case when l_partkey % 9 = 0 then 0.02 else 0 end {n}" for n, (c, r) in VERIFIED.items())} from lineitem group by l_partkey, l_returnflag),
    c as ({" union all ".join(f"select '{n}' as \"column\", abs(f.{n} - p.{n}) delta from f join p using (k, f)" for n in VERIFIED)})
    select "column", count(*) n, count(*) filter (delta > 0.01) as over, round(max(delta), 4) worst from c group by 1""")
def a17(s, d):
    """Averages over the shots that count (numbers up to those stated, here 5) against published cells, some of which were misprinted."""
    li = table(s, d, "lineitem").withColumnsRenamed({"l_partkey": "k", "l_returnflag": "f"})
    found = li.where("l_linenumber <= 5").groupBy("k", "f").agg(*(F.avg(c).alias(n) for n, (c, _) in VERIFIED.items()))
    off = F.when(F.col("k") % 9 == 0, 0.02).otherwise(0.0)
    published = li.groupBy("k", "f").agg(*(L.to_places(F.avg(c), r).alias(n) for n, (c, r) in VERIFIED.items())).withColumns({n: F.col(n) + off for n in VERIFIED})
    return statistics.verify(found, published, ["k", "f"], list(VERIFIED)).withColumn("worst", L.to_places("worst", 4))


@query("A18_uncertainty", f"""with g as (select stddev_samp(value) sd, count(*) n, min(shot) f, arg_min(value, shot) v, sum(value) t from {SHOTS} where not excluded group by run, mic)
    select round(median(sd), 6) median_sd, round(avg(case when f = 1 and n >= 2 then (v - (t - v) / (n - 1) > 0)::int end), 6) positive_pops from g""")
def a18(s, d):
    st = statistics.run_statistics(shots(s, d), ["run", "mic"])
    share = st.agg(F.round(F.avg((F.col("pop") > 0).cast("int")), 6).alias("positive_pops"))
    return share.join(F.broadcast(statistics.median(st, "sd").select(F.round("median", 6).alias("median_sd"))))


@query("A19_spellings", f"""select maker, list_sort(list(distinct model)) spellings, count(*) tested, count(distinct host) hosts from {DEVICES} group by 1""")
def a19(s, d):
    return views.spellings(devices(s, d), "maker", "model", "host")


@query("A20_first_record", f"""select run, mic, min(shot) shot, arg_min(value, shot) as value from {SHOTS} where not excluded group by all""")
def a20(s, d):
    return views.first_record(shots(s, d), ["run", "mic"], "shot", "value", ~F.col("excluded"))


@query("A22_attribute_coverage", f"""select 'price' measure, count(nullif(price % 3 < 1, true)) n from {DEVICES} union all select 'weight', count(nullif(weight, 11)) from {DEVICES}""")
def a22(s, d):
    rows = devices(s, d).select(F.when(F.col("price") % 3 >= 1, F.col("price")).alias("price"), F.nullif("weight", F.lit(11.0)).alias("weight"))
    return statistics.availability(rows, ["price", "weight"])


@query("A23_mics_of_run", f"""select run, list(mic order by case mic when 'view' then 0 when 'click' then 1 else 2 end, mic) mics from (select distinct run, mic from {SHOTS}) group by 1""")
def a23(s, d):
    place = F.when(F.col("mic") == "view", 0).when(F.col("mic") == "click", 1).otherwise(2)
    return shots(s, d).groupBy("run").agg(F.transform(F.array_sort(F.collect_set(F.struct(place.alias("o"), "mic"))), lambda x: x.mic).alias("mics"))


@query("A24_integrity", f"""select 'unknown host' violation, host as key from {DEVICES} where host not in ('ECONOMY', 'SMALL', 'LARGE', 'PROMO') group by 2
    union all select 'model of several makers', model from {DEVICES} group by model having count(distinct maker) > 5""")
def a24(s, d):
    known = s.createDataFrame([(h,) for h in ("ECONOMY", "SMALL", "LARGE", "PROMO")], "host string")
    rows = devices(s, d)
    unknown = rows.join(F.broadcast(known), "host", "left_anti").select(F.lit("unknown host").alias("violation"), F.col("host").alias("key")).distinct()
    return unknown.union(rows.groupBy("model").agg(F.countDistinct("maker").alias("n")).where("n > 5").select(F.lit("model of several makers"), "model"))


@query("F01_runs", """select p_partkey run, p_brand maker, p_name model from part where p_brand = 'Brand#3' and p_type = 'SMALL'""")
def f01(s, d):
    return devices(s, d).where("maker = 'Brand#3' and host = 'SMALL'").select("run", "maker", "model").orderBy("run")


@query("F02_waveforms", f"""select run, mic, shot, value from {SHOTS} where run = 7 and mic = 'view'""")
def f02(s, d):
    return shots(s, d).where("run = 7 and mic = 'view'").select("run", "mic", "shot", "value").orderBy("mic", "shot")


@query("F03_waveform_index", """select l_orderkey run, l_linenumber shot, o_orderpriority host from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'P'""")
def f03(s, d):
    li, o = table(s, d, "lineitem"), table(s, d, "orders").where("o_orderstatus = 'P'")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("shot"), F.col("o_orderpriority").alias("host"))


@query("F04_selection", f"""select run, host, weight from {DEVICES} where host in ('SMALL', 'PROMO') and weight >= 10 and weight <= 20 and price >= 950""")
def f04(s, d):
    return filters.selection(devices(s, d), {"host": {"SMALL", "PROMO"}, "weight": (10, 20), "price": (950, None)}).select("run", "host", "weight")


@query("F05_visible_rows", f"""select run, maker from {DEVICES} where host = 'SMALL' and not is_baseline and weight between 5 and 40 and maker in ('Brand#2', 'Brand#3', 'Brand#4')""")
def f05(s, d):
    return filters.selection(devices(s, d).where("not is_baseline"), {"host": {"SMALL"}, "weight": (5, 40), "maker": {"Brand#2", "Brand#3", "Brand#4"}}).select("run", "maker")


@query("F06_active_years", f"""with p as (select distinct year from {TESTS}), a as (select * from (values (1996), (1999), (2050)) v(year)), k as (select year from p semi join a using (year))
    select year from k union all select year from p where (select count(*) from k) = 0""")
def f06(s, d):
    return filters.years_or_all(s.createDataFrame([(1996,), (1999,), (2050,)], "year int"), tests(s, d).select("year"), "year")


@query("F07_dimensions", f"""select run, case when run % 10 = 3 then null else nullif(weight, 11) end weight from {DEVICES}""")
def f07(s, d):
    rows = devices(s, d)
    bad = rows.where("run % 10 = 3").select("run", F.array(F.lit("weight")).alias("fields"))
    rows = rows.withColumn("weight", F.when(F.col("weight") != 11, F.col("weight")).otherwise(0.0))
    return filters.known_dimensions(rows, ["run"], ["weight"], bad).select("run", "weight")


@query("F08_reference_runs", f"""select run, maker in ('Bare', 'Bare Muzzle') or lower(trim(' ' || model || ' ')) = 'hand' reference from (select run, case when run % 5 = 0 then 'Bare' else maker end maker, case when run % 7 = 0 then ' HAND' else model end model from {DEVICES})""")
def f08(s, d):
    rows = devices(s, d).select("run", F.when(F.col("run") % 5 == 0, "Bare").otherwise(F.col("maker")).alias("maker"), F.when(F.col("run") % 7 == 0, " HAND").otherwise(F.col("model")).alias("model"))
    return rows.select("run", N.is_reference("maker", "model").alias("reference"))


@query("F09_finite", f"""select run, case when run % 4 in (0, 1) then null else price end price from {DEVICES}""")
def f09(s, d):
    odd = F.when(F.col("run") % 4 == 0, float("nan")).when(F.col("run") % 4 == 1, float("inf")).otherwise(F.col("price"))
    return devices(s, d).select("run", L.finite(odd).alias("price"))


@query("F11_sample", f"""select run, maker from {DEVICES} where host <> 'PROMO' order by run * 7919 % 104729, run limit 40""")
def f11(s, d):
    return filters.pseudo_random(devices(s, d).where("host <> 'PROMO'"), "run", 40).select("run", "maker")


@query("F13_availability", f"""select 'weight' measure, count(weight) n from {DEVICES} union all select 'price', count(price) from {DEVICES} union all select 'sem', count(nullif(sem, 0.05)) from {DEVICES}""")
def f13(s, d):
    return statistics.availability(devices(s, d).withColumn("sem", F.nullif("sem", F.lit(0.05))), ["weight", "price", "sem"])


@query("F14_ranges", f"""with e as (select host, min(weight) lo, max(weight) hi from {DEVICES} group by 1), r as (select run, host, least(weight + 3, 50 - weight) a, greatest(weight + 3, 50 - weight) b from {DEVICES})
    select run, case when a > lo + 0.5 then a end "from", case when b < hi - 0.5 then b end "to" from r join e using (host)""")
def f14(s, d):
    rows = devices(s, d)
    return rows.join(statistics.extent(rows, "weight", ("host",)), "host").select("run", filters.range_of(F.col("weight") + 3, 50 - F.col("weight"), F.col("lo"), F.col("hi"), F.lit(1.0)).alias("r")).select("run", "r.from", "r.to")


@query("J01_measurements", """select p_partkey run, p_brand maker, l_returnflag mic, round(avg(l_extendedprice), 4) as value from part join lineitem on l_partkey = p_partkey group by all""")
def j01(s, d):
    m = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("run"), F.col("l_returnflag").alias("mic")).agg(F.round(F.avg("l_extendedprice"), 4).alias("value"))
    return devices(s, d).select("run", "maker").join(m, "run")


@query("J02_run_view", """with m as (select l_partkey run, l_returnflag mic, round(avg(l_extendedprice), 4) v, count(*) n from lineitem group by all)
    select p_partkey run, max(v) filter (mic = 'A') a, max(v) filter (mic = 'N') n, max(v) filter (mic = 'R') r, coalesce(sum(m.n), 0)::bigint waveforms, round(0.785 * p_size * p_size * p_retailprice, 6) volume from part left join m on run = p_partkey group by p_partkey, p_size, p_retailprice""")
def j02(s, d):
    m = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("run"), F.col("l_returnflag").alias("mic")).agg(F.round(F.avg("l_extendedprice"), 4).alias("v"), F.count("*").alias("n"))
    wide = m.groupBy("run").agg(*(F.max(F.when(F.col("mic") == k.upper(), F.col("v"))).alias(k) for k in "anr"), F.sum("n").alias("waveforms"))
    return devices(s, d).join(wide, "run", "left").select("run", "a", "n", "r", F.coalesce("waveforms", F.lit(0)).alias("waveforms"), F.round(L.volume("weight", "price"), 6).alias("volume"))


@query("J03_shot_view", """select l_orderkey run, l_linenumber shot, year(o_orderdate)::int as year, l_extendedprice as value from lineitem join orders on l_orderkey = o_orderkey""")
def j03(s, d):
    li, o = table(s, d, "lineitem"), tests(s, d).select("run", "year")
    return li.join(o, li.l_orderkey == o.run).select("run", F.col("l_linenumber").alias("shot"), "year", F.col("l_extendedprice").alias("value"))


@query("J03_shot_view_all", """select l_orderkey run, l_linenumber shot, year(o_orderdate)::int as year, l_extendedprice as value from lineitem join orders on l_orderkey = o_orderkey""")
def j03_all(s, d):
    return j03(s, d)


MATCH = f"""with r as (select run, maker, case when run % 4 = 0 then model || ' x' else model end model, host, weight, price from {DEVICES} where run % 3 <> 0), p as (select run row, maker, model, host, weight, price from {DEVICES}),
    nm as (select run, min(row) row from r join p using (maker, model, host, price) group by 1),
    c as (select r.run, f.row from (select * from r where run not in (select run from nm)) r join (select * from p where row not in (select row from nm)) f on r.maker = f.maker and r.host = f.host and r.weight = f.weight and abs(r.price - f.price) <= greatest(1e-9 * greatest(abs(r.price), abs(f.price)), 1e-9)),
    k as (select *, count(*) over (partition by run) n, row_number() over (partition by row order by run) f from c),
    m as (select run, row, 'name' how from nm union all select run, row, 'specs' from k where n = 1 and f = 1)"""


def matched(s, d):
    rows = devices(s, d)
    runs = rows.where("run % 3 <> 0").withColumn("model", F.when(F.col("run") % 4 == 0, F.concat("model", F.lit(" x"))).otherwise(F.col("model")))
    return runs, rows, matching.match_runs(runs, rows.withColumnRenamed("run", "row"), "run", "row", ["maker", "model", "host", "price"], ["maker", "host"], ["weight", "price"])


@query("J04_match_by_key", MATCH + " select run, row from m where how = 'name'")
def j04(s, d):
    return matched(s, d)[2].where("how = 'name'").select("run", "row")


@query("J05_match_by_specs", MATCH + " select run, row, how from m")
def j05(s, d):
    return matched(s, d)[2]


#: Runs and rows with few specs, so that many have several candidates; sizes lie next to one another within the tolerance, two steps apart they don't.
NEAR = "floor(price / 150) * (1 + (run % 3) * 0.7e-9::double)"
IN_TURN = f"""with recursive r as (select run, host, weight % 7 weight, {NEAR} size from {DEVICES} where run % 2 = 0), p as (select run row, host, weight % 7 weight, {NEAR} size from {DEVICES} where run % 20 = 1),
    c as (select r.run, p.row from r join p on r.host = p.host and r.weight = p.weight and abs(r.size - p.size) <= greatest(1e-9::double * greatest(r.size, p.size), 1e-9::double)),
    o as (select run, list(row) options, row_number() over (order by run) i from c group by run),
    walk(i, used, run, row) as (select 0::bigint, []::bigint[], null::bigint, null::bigint union all
        select i, case when len(rest) = 1 then list_append(used, rest[1]) else used end, run, case when len(rest) = 1 then rest[1] end from (select o.i, used, o.run, list_filter(options, lambda x: not list_contains(used, x)) rest from walk join o on o.i = walk.i + 1))"""


@query("J05_match_in_turn", IN_TURN + " select run, row from walk where row is not null")
def j05b(s, d):
    """Runs take rows one after the other; a row taken can leave a later run with just one candidate."""
    size = F.floor(F.col("price") / 150) * (1 + (F.col("run") % 3) * 0.7e-9)
    specs = devices(s, d).select("run", "host", (F.col("weight") % 7).alias("weight"), size.alias("size"))
    return matching.match_in_turn(specs.where("run % 2 = 0"), specs.where("run % 20 = 1").withColumnRenamed("run", "row"), "run", "row", ["host"], ["weight", "size"])


@query("J06_match_report", MATCH + " select how, count(*) n from m group by 1 union all select 'unmatched run', count(*) from r where run not in (select run from m) union all select 'unmatched row', count(*) from p where row not in (select row from m)")
def j06(s, d):
    runs, rows, m = matched(s, d)
    lost = lambda name, a, k, b: a.join(m.select(F.col(b).alias(k)), k, "left_anti").agg(F.lit(name).alias("how"), F.count("*").alias("n"))
    return m.groupBy("how").agg(F.count("*").alias("n")).union(lost("unmatched run", runs, "run", "run")).union(lost("unmatched row", rows, "run", "row"))


@query("J07_net_reduction", f"""with b as (select year, host, arg_max(value, run) ref from {TESTS} where is_baseline group by all) select run, year, host, round(ref - value, 4) reduction from {TESTS} t join b using (year, host) where not is_baseline""")
def j07(s, d):
    return rounded(statistics.net_reduction(tests(s, d), ["year", "host"], "value", "is_baseline", "run"), "reduction", to=4)


@query("J08_todo", """select o_orderkey run from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 20)""")
def j08(s, d):
    done = table(s, d, "lineitem").where("l_quantity > 20").select(F.col("l_orderkey").alias("run"))
    return tests(s, d).select("run").join(done, "run", "left_anti")


@query("J09_frontier2", f"""select run, host, weight, price from {DEVICES} a where not exists (select 1 from {DEVICES} b where b.host = a.host and b.weight <= a.weight and b.price <= a.price and (b.weight < a.weight or b.price < a.price))""")
def j09(s, d):
    return ranking.frontier2(devices(s, d), ["host"], "weight", "price").select("run", "host", "weight", "price")


FRONT3 = """with p as (select *, o_orderkey % 97 z from orders {where}) select o_orderkey run, o_totalprice price, z, o_custkey client from p a where not exists (select 1 from p b where {same}b.o_totalprice <= a.o_totalprice and b.z >= a.z and b.o_custkey <= a.o_custkey and (b.o_totalprice < a.o_totalprice or b.z > a.z or b.o_custkey < a.o_custkey))"""


def front3(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_totalprice").alias("price"), (F.col("o_orderkey") % 97).alias("z"), F.col("o_custkey").alias("client"), F.col("o_orderpriority").alias("host"), F.col("o_orderstatus").alias("status"))


@query("J09_frontier3", FRONT3.format(where="", same=""))
def j09b(s, d):
    return ranking.frontier(front3(s, d), {"price": "min", "z": "max", "client": "min"}).select("run", "price", "z", "client")


@query("J09_frontier_of_groups", FRONT3.format(where="where o_orderstatus <> 'F'", same="b.o_orderpriority = a.o_orderpriority and "))
def j09c(s, d):
    """Of each host, among the runs that a mask leaves."""
    return ranking.frontier(front3(s, d), {"price": "min", "z": "max", "client": "min"}, ["host"], F.col("status") != "F").select("run", "price", "z", "client")


@query("J10_frontier_dropping", FRONT3.format(where="where o_orderkey % 6 <> 0", same="").replace("b.z >= a.z and ", "").replace("b.z > a.z or ", ""))
def j10b(s, d):
    """z has no better side: it must be finite, and is no objective."""
    rows = front3(s, d).withColumn("z", F.when(F.col("run") % 6 != 0, F.col("z").cast("double")).otherwise(float("nan")))
    return ranking.frontier_of_finite(rows, {"price": "min", "z": None, "client": "min"}).select("run", "price", F.col("z").cast("long").alias("z"), "client")


@query("J10_frontier_finite", f"""with p as (select * from {DEVICES} where run % 6 <> 0) select run, host from p a where not exists (select 1 from p b where b.host = a.host and b.weight <= a.weight and b.price >= a.price and (b.weight < a.weight or b.price > a.price))""")
def j10(s, d):
    rows = devices(s, d).withColumn("price", F.when(F.col("run") % 6 != 0, F.col("price")))
    return ranking.frontier2(rows, ["host"], "weight", "price", ("min", "max")).select("run", "host")


@query("J11_tied_with", f"""select b.run, b.price from {DEVICES} a join {DEVICES} b on a.host = b.host and a.run = 17 and b.run <> 17 and abs(a.price - b.price) < 2 * sqrt(a.sem * a.sem + b.sem * b.sem)""")
def j11(s, d):
    return ranking.tied_with(devices(s, d), ["host"], "price", "sem", "run", 17).select("run", "price")


@query("J12_host_attributes", """select c_custkey run, coalesce(n_name, c_nationkey::varchar) label, n_regionkey platform from customer left join (select * from nation where n_nationkey % 5 <> 0) on n_nationkey = c_nationkey""")
def j12(s, d):
    hosts = table(s, d, "nation").where("n_nationkey % 5 <> 0")
    c = table(s, d, "customer")
    hosts = hosts.select(F.col("n_nationkey").alias("host"), F.col("n_name").alias("label"), F.col("n_regionkey").alias("platform"))
    return views.with_hosts(c.select(F.col("c_custkey").alias("run"), F.col("c_nationkey").alias("host")), hosts, "host", "label").drop("host")


@query("J13_with_waveforms", """select o_orderkey run from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')""")
def j13(s, d):
    li = table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("run"))
    return tests(s, d).select("run").join(li, "run", "left_semi")


@query("J15_predecessor", """with g as (select o_custkey % 100 host, count(*) runs, count(distinct year(o_orderdate)) as years, min(year(o_orderdate)) y from orders where o_orderstatus <> 'P' and (o_custkey % 100 >= 50 or year(o_orderdate) = 1995) group by 1), o as (select host from g where host < 50 and years = 1 and y = 1995)
    select host, host - 50 earlier from g where host >= 50 and years > 1 and host - 50 in (select host from o)""")
def j15(s, d):
    """Hosts below 50 were tested in 1995 only, and are labelled as the host 50 above them with the year behind it."""
    rows = tests(s, d).withColumn("host", F.col("client") % 100).where("host >= 50 or year = 1995")
    labels = s.range(100).select(F.col("id").alias("host"), F.when(F.col("id") < 50, F.concat(F.col("id") + 50, F.lit(" (1995)"))).otherwise(F.col("id").cast("string")).alias("label"))
    return views.host_tiers(rows, "host", "year", "is_baseline", labels, 1995).where("earlier is not null").select("host", "earlier")


NUMBERED = """with e as (select event_id, user_id run, event_type signal, event_id % 11 = 0 excluded, case when user_id % 3 = 0 or event_id % 2 = 0 then 10 + event_id * 2 end folder, case when user_id % 3 = 1 or event_id % 5 > 0 then ts end as "at", case when event_id % 4 = 0 then 'txt' else (event_id % 97)::varchar end suffix, lpad(event_id::varchar, 9, '0') file from events),
    r as (select * from e where not excluded), g as (select run, signal, count(*) n, count(folder) folders, count("at") times, max(folder) top from r group by all),
    k as (select event_id, case when folders = n then folder when times = n then row_number() over (partition by run, signal order by "at", file) else row_number() over (partition by run, signal order by suffix = 'txt', suffix, file) end shot, case when folders = n then 'folder' when times = n then 'time' else 'name' end rule from r join g using (run, signal)),
    x as (select event_id, case when folders = n then top else coalesce(n, 0) end + row_number() over (partition by run, signal order by file) shot, case when folders = n then 'folder' when coalesce(times = n, true) then 'time' else 'name' end rule from e left join g using (run, signal) where excluded)"""


def captures(s, d):
    """Captures of which some state their number, some lack a time, and some are spare."""
    i, u = F.col("event_id"), F.col("user_id")
    return table(s, d, "events").select("event_id", u.alias("run"), F.col("event_type").alias("signal"), (i % 11 == 0).alias("excluded"), F.when((u % 3 == 0) | (i % 2 == 0), 10 + i * 2).alias("folder"), F.when((u % 3 == 1) | (i % 5 > 0), F.col("ts")).alias("at"), F.when(i % 4 == 0, "txt").otherwise((i % 97).cast("string")).alias("suffix"), F.lpad(i.cast("string"), 9, "0").alias("file"))


@query("W01_shot_numbers", NUMBERED + " select event_id, shot, rule from k union all select event_id, shot, rule from x")
def w01(s, d):
    return numbering.shot_numbers(captures(s, d), ["run", "signal"], "folder", "at", "suffix", "file", "excluded").select("event_id", "shot", "rule")


@query("W02_rank_order", f"""select run, row_number() over (order by price, run) "rank", count(*) over () field from {DEVICES} where host = 'SMALL' and weight < 20""")
def w02(s, d):
    return ranking.rank_order(devices(s, d).where("host = 'SMALL' and weight < 20"), ["host"], "price", "run").select("run", "rank", "field")


@query("W03_rank_on_host", f"""select run, host, row_number() over (partition by host order by -price, run) "rank", count(*) over (partition by host) field from {DEVICES} where not is_baseline""")
def w03(s, d):
    return ranking.rank_order(devices(s, d).where("not is_baseline"), ["host"], "price", "run", "max").select("run", "host", "rank", "field")


@query("W04_leader_ties", f"""with r as (select *, row_number() over (partition by host order by price, run) k from {DEVICES}), t as (select r.host, r.k, r.k = 1 or abs(r.price - l.price) < 2 * sqrt(r.sem * r.sem + l.sem * l.sem) tied from r join r l on l.host = r.host and l.k = 1)
    select host, count(*) filter (tied) tied, max(k) filter (tied) as depth from t group by 1""")
def w04(s, d):
    return ranking.leader_ties(devices(s, d), ["host"], "price", "sem", "run")


@query("W05_rank_fraction", f"""select run, round((k - 1) / greatest(1, n - 1)::double, 6) fraction, (k - 1) / greatest(1, n - 1)::double <= 0.25 top from (select run, row_number() over (partition by host order by price, run) k, count(*) over (partition by host) n from {DEVICES})""")
def w05(s, d):
    return rounded(views.rank_fractions(ranking.rank_order(devices(s, d), ["host"], "price", "run")).select("run", "fraction", "top"), "fraction")


@query("W06_offsets", """select doc_id, n_chars, (coalesce(sum(n_chars) over (order by doc_id rows between unbounded preceding and 1 preceding), 0))::bigint "offset" from documents""")
def w06(s, d):
    return offsets.prefix_sums(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id", {"n_chars": "offset"})


@query("W06_stride_offsets", """select vec_id, 256 * (row_number() over (order by label, vec_id) - 1) "offset" from embeddings""")
def w06b(s, d):
    """Records of one size, in an order with ties."""
    return offsets.stride_offsets(table(s, d, "embeddings").select("vec_id", "label"), "label", 256, "offset", tie="vec_id").select("vec_id", "offset")


@query("W07_run_index", """select run, min(pos) first, count(*) n from (select user_id run, row_number() over (order by user_id, event_id) - 1 pos from events) group by 1""")
def w07(s, d):
    """Position of the first record of each run, in the order of run and record."""
    return views.contiguous_index(table(s, d, "events").select(F.col("user_id").alias("run")), "run")


@query("W12_first_shot", f"""select run, mic, shot, value from (select *, row_number() over (partition by run, mic order by excluded, shot) r from {SHOTS}) where r = 1""")
def w12(s, d):
    return views.first_captures(shots(s, d), ["run", "mic"], "shot", "excluded").select("run", "mic", "shot", "value")


@query("K01_quietest", f"""select run, price from {DEVICES} where host = 'SMALL' and price is not null order by price, run limit 10""")
def k01(s, d):
    return views.quietest(devices(s, d), "price", "run", F.col("host") == "SMALL").select("run", "price")


@query("K02_frontier_step", f"""with f as (select * from {DEVICES} a where not exists (select 1 from {DEVICES} b where b.host = a.host and b.weight <= a.weight and b.price <= a.price and (b.weight < a.weight or b.price < a.price))),
    g as (select *, weight - lag(weight) over w dx, price - lag(price) over w dy, row_number() over (partition by host order by weight desc, run desc) b from f window w as (partition by host order by weight, run))
    select host, dx, round(dy, 6) dy from g where b = 1 and dx is not null""")
def k02(s, d):
    front = ranking.frontier2(devices(s, d), ["host"], "weight", "price")
    return rounded(ranking.frontier_path(front, ["host"], "weight", "price", "run"), "dy")


@query("K03_device_search", f"""select maker, model, count(*) runs, max(starts_with(model, 'red') or starts_with(model, 'brand')) prefix from {DEVICES} where not is_baseline and contains(lower(maker || ' ' || model), 'red') and contains(lower(maker || ' ' || model), 'brand') group by all order by prefix desc, runs desc, model, maker limit 8""")
def k03(s, d):
    return views.device_search(devices(s, d), "red Brand", "maker", "model", "is_baseline")


@query("K04_option_search", f"""select maker as option, count(*) n from {DEVICES} where contains(lower(maker), '#1') and maker <> 'Brand#1' group by 1 order by n desc, 1 limit 8""")
def k04(s, d):
    return views.option_search(devices(s, d), "maker", "#1", ["Brand#1"])


@query("K05_runs_of_device", f"""select run, weight from {DEVICES} where maker = 'Brand#2' and model = 'red widget' and not is_baseline""")
def k05(s, d):
    return views.runs_of_device(devices(s, d), (F.col("maker") == "Brand#2") & (F.col("model") == "red widget"), "is_baseline", "weight", "run").select("run", "weight")


@query("K06_device_page", f"""select run, k "rank", n field from (select *, row_number() over (partition by host order by price, run) k, count(*) over (partition by host) n from {DEVICES}) where maker = 'Brand#2'""")
def k06(s, d):
    return views.device_page(ranking.rank_order(devices(s, d), ["host"], "price", "run"), F.col("maker") == "Brand#2", "run").select("run", "rank", "field")


@query("K07_compare", f"""with r as (select * from {DEVICES} where run in (3, 17, 29)), u as (select 'weight' measure, run, weight as value from r union all select 'price', run, price from r)
    select measure, run, value, (select count(distinct host) from r) = 1 and value = min(value) over (partition by measure) best from u""")
def k07(s, d):
    r = devices(s, d).where(F.col("run").isin(3, 17, 29))
    u = r.select("run", "host", F.explode(F.create_map(F.lit("weight"), "weight", F.lit("price"), "price")).alias("measure", "value"))
    w = W.partitionBy("measure")
    one = F.size(F.collect_set("host").over(w)) == 1
    return u.select("measure", "run", "value", (one & (F.col("value") == F.min("value").over(w))).alias("best"))


@query("U01_accumulate_years", f"""select run, year, value from {TESTS}""")
def u01(s, d):
    """Years come to a stored table in two releases, each of them one write, whatever the number of years."""
    t, stored = tests(s, d).select("run", "year", "value"), YearTable(s, store.fresh_folder(s, "years"))
    stored.load(t.where("year % 2 = 0"))
    stored.load(t.where("year % 2 <> 0"))
    return stored.read()


@query("U01_accumulate_all_years", f"""select run, year, value from {TESTS}""")
def u01_all(s, d):
    """All years that are present, undated runs too, in one write."""
    stored = YearTable(s, store.fresh_folder(s, "years"))
    stored.load(tests(s, d).select("run", "year", "value"))
    return stored.read()


@query("U02_union_of_bands", f"""with b as (select mic, shot % 16 as col, min(value) lo, max(value) hi from {SHOTS} group by all) select *, min(lo) over (partition by mic) from_lo, max(hi) over (partition by mic) to_hi from b""")
def u02(s, d):
    return views.united_bands(shots(s, d), ["mic"], F.col("shot") % 16, "value", "value")


@query("U03_unused_rows", MATCH + " select row, maker from p where row not in (select row from m)")
def u03(s, d):
    _, rows, m = matched(s, d)
    return views.unused_rows(rows.select(F.col("run").alias("row"), "maker"), m, "row")


@query("U04_footnote_years", f"""select distinct year from {TESTS} where host = '1-URGENT' and value > 100""")
def u04(s, d):
    return filters.footnote_years(tests(s, d), "year", (F.col("host") == "1-URGENT") & (F.col("value") > 100))


SPELLED = f"(select run, case run % 4 when 0 then ' YHM ' when 1 then 'Bare' when 2 then 'C.A.T' else maker end maker, model from {DEVICES})"


def spelled(s, d):
    k = F.col("run") % 4
    return devices(s, d).select("run", F.when(k == 0, " YHM ").when(k == 1, "Bare").when(k == 2, "C.A.T").otherwise(F.col("maker")).alias("maker"), "model")


CANON = "case trim(maker) when 'YHM' then 'Yankee Hill Machine' when 'Bare' then 'Bare Muzzle' when 'C.A.T' then 'CAT' else trim(maker) end"
SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"


@query("C01_canonical_maker", f"select run, {CANON} maker from {SPELLED}")
def c01(s, d):
    return spelled(s, d).select("run", N.canonical_maker("maker").alias("maker"))


@query("C02_slug", f"select run, {SLUG.format('maker')} slug from {SPELLED}")
def c02(s, d):
    return spelled(s, d).select("run", N.slug("maker").alias("slug"))


@query("C03_device_key", f"select run, {SLUG.format(CANON)} || '/' || regexp_replace(lower(model), '[^a-z0-9]', '', 'g') device from {SPELLED}")
def c03(s, d):
    return spelled(s, d).select("run", N.device_key("maker", "model").alias("device"))


@query("C04_settled_name", f"select run, case when starts_with(lower(model), lower(maker)) then model else maker || ' ' || model end as name from (select run, maker, case when run % 3 = 0 then lower(maker) || ' ' || model else model end model from {DEVICES})")
def c04(s, d):
    rows = devices(s, d).withColumn("model", F.when(F.col("run") % 3 == 0, F.concat_ws(" ", F.lower("maker"), "model")).otherwise(F.col("model")))
    return rows.select("run", N.full_name("maker", "model").alias("name"))


@query("C05_merged_notes", f"select run, nullif(concat_ws('; ', nullif(trim(case when run % 2 = 0 then ' ' || maker else '  ' end), ''), case when run % 3 = 0 then model end), '') note from {DEVICES}")
def c05(s, d):
    return devices(s, d).select("run", N.merged_notes(F.when(F.col("run") % 2 == 0, F.concat(F.lit(" "), "maker")).otherwise("  "), F.when(F.col("run") % 3 == 0, F.col("model"))).alias("note"))


CAVEATS = [(1996, "1-URGENT", ["A", "N"], "ignore", "harmonic"), (1997, "2-HIGH", ["R"], "note", "wind")]


@query("C07_caveat_flag", f"select run, case when year = 1996 and host = '1-URGENT' then 'harmonic' when year = 1997 and host = '2-HIGH' then 'wind' end caveat from {TESTS}")
def c07(s, d):
    advice = s.createDataFrame(CAVEATS, "year int, cartridge string, mics array<string>, severity string, summary string")
    return tests(s, d).join(F.broadcast(views.caveat_flags(advice).withColumnRenamed("cartridge", "host")), ["year", "host"], "left").select("run", "caveat")


@query("C08_caveat_mask", f"""select l_orderkey run, l_linenumber shot, l_returnflag mic, case when year = 1996 and host = '1-URGENT' and l_returnflag in ('A', 'N') then 'ignore' when year = 1997 and host = '2-HIGH' and l_returnflag = 'R' then 'note' end severity from lineitem join {TESTS} on run = l_orderkey""")
def c08(s, d):
    return c08_all(s, d)


@query("C08_caveat_mask_all", f"""select l_orderkey run, l_linenumber shot, l_returnflag mic, case when year = 1996 and host = '1-URGENT' and l_returnflag in ('A', 'N') then 'ignore' when year = 1997 and host = '2-HIGH' and l_returnflag = 'R' then 'note' end severity from lineitem join {TESTS} on run = l_orderkey""")
def c08_all(s, d):
    c = s.createDataFrame(CAVEATS, "year int, host string, mics array<string>, severity string, summary string").select("year", "host", F.explode("mics").alias("mic"), "severity")
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("shot"), F.col("l_returnflag").alias("mic"))
    return li.join(tests(s, d).select("run", "year", "host"), "run").join(F.broadcast(c), ["year", "host", "mic"], "left").select("run", "shot", "mic", "severity")


@query("C09_ammo_class", f"select run, case when run % 3 = 0 then 'subsonic' when run % 3 = 1 then 'supersonic' end ammo from {DEVICES}")
def c09(s, d):
    sub = F.when(F.col("run") % 3 == 0, True).when(F.col("run") % 3 == 1, False)
    return devices(s, d).select("run", views.ammo(sub).alias("ammo"))


@query("C10_volume", f"select run, round(0.785 * weight * weight * nullif(price, 900), 6) volume from {DEVICES}")
def c10(s, d):
    return devices(s, d).select("run", F.round(L.volume("weight", F.nullif("price", F.lit(900.0))), 6).alias("volume"))


@query("C11_level", f"select event_id, round(case when value - 5 > 0 then 20 * log10((value - 5) / 2e-5) end, 6) db from {SHOTS}")
def c11(s, d):
    return table(s, d, "events").select("event_id", F.round(L.level(F.col("value") - 5), 6).alias("db"))


@query("C12_indistinguishable", f"select a.run, coalesce(abs(a.price - b.price) < 2 * sqrt(a.sem * a.sem + b.sem * b.sem), false) same from {DEVICES} a join {DEVICES} b on b.run = a.run + 1")
def c12(s, d):
    a = devices(s, d)
    b = a.select((F.col("run") - 1).alias("run"), F.col("price").alias("p"), F.col("sem").alias("q"))
    return a.join(b, "run").select("run", L.indistinguishable("price", "sem", "p", "q").alias("same"))


@query("C13_half_away", f"select run, round((weight - 25) / 2)::bigint k from {DEVICES}")
def c13(s, d):
    return devices(s, d).select("run", L.half_away((F.col("weight") - 25) / 2).alias("k"))


@query("C17_error_bars", f"select run, round(price - sem, 6) lo, round(price + sem, 6) hi from {DEVICES}")
def c17(s, d):
    return devices(s, d).select("run", F.round(F.col("price") - F.coalesce("sem", F.lit(0.0)), 6).alias("lo"), F.round(F.col("price") + F.coalesce("sem", F.lit(0.0)), 6).alias("hi"))


@query("P05_dictionary", """select doc_id, dense_rank() over (order by f) - 1 code from documents join (select source, min(doc_id) f from documents group by 1) using (source)""")
def p05(s, d):
    return N.encoded(table(s, d, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "code")


@query("P05_decoded", "select doc_id, source from documents")
def p05b(s, d):
    """The codes of a column turned back into its values."""
    docs = table(s, d, "documents").select("doc_id", "source")
    return N.decoded(N.encoded(docs, "source", "doc_id"), N.dictionary(docs, "source", "doc_id"), "code", "again").select("doc_id", F.col("again").alias("source"))
