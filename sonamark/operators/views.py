"""The three flattened views over the stored tables, the run catalogue, and tables about hosts, years and devices.

Stored tables: dataset (id, year), test_run (id, dataset_id, event_label, event_date, manufacturer, suppressor, caliber, cartridge, is_baseline, shots,
weight_oz, length_in, max_diameter_in), summary_metric (test_run_id, mic, the published metrics), waveform (id, test_run_id, mic, shot, excluded, captured_at,
overload), shot_metric (waveform_id and the metrics of a shot), band_level (waveform_id, levels). Runs, metrics and waveforms grow, so they are joined by
shuffle; a mic-wise pivot is one aggregate over the metrics, not a join for each mic.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.levels import MIC_ORDER, volume
from ..sources.store import kept
from .offsets import numbered, prefix_sums, same

RUN = ["event_label", "event_date", "manufacturer", "suppressor", "caliber", "cartridge", "is_baseline", "shots", "weight_oz", "length_in", "max_diameter_in"]
METRICS = ["peak_pressure_pa", "peak_db", "peak_dba", "impulse_pa_ms", "impulse_db_ms", "peak_leq10ms_dba"]
SHOT_METRICS = ["peak_pa", "peak_db", "peak_dba", "impulse_pa_ms", "impulse_db_ms", "peak_leq10ms_dba"]
#: Which published metrics of which microphone the run view has, and the prefix of their columns.
PIVOT = {"SE": ("se", METRICS[1:3] + METRICS[4:]), "ML": ("ml", METRICS[1:3] + METRICS[4:]), "MR": ("mr", METRICS[1:3]), "225": ("p225", METRICS[1:3])}


@dataclass
class Store:
    dataset: DataFrame
    test_run: DataFrame
    summary_metric: DataFrame
    waveform: DataFrame
    shot_metric: DataFrame
    band_level: DataFrame | None = None


def runs_by_year(db: Store) -> DataFrame:
    """year, test_run_id and the run's columns; runs without a data set are not there."""
    years = db.dataset.select(F.col("id").alias("dataset_id"), "year")
    return db.test_run.join(years, "dataset_id").select("year", F.col("id").alias("test_run_id"), *RUN)


def v_measurement(db: Store) -> DataFrame:
    """A row for each published (run, microphone)."""
    return runs_by_year(db).join(db.summary_metric.select("test_run_id", "mic", *METRICS), "test_run_id")


def published_runs(db: Store) -> DataFrame:
    """A row for each run: the published metrics of its microphones side by side, and its volume."""
    picks = [F.max(F.when(F.col("mic") == mic, F.col(m))).alias(f"{prefix}_{m}") for mic, (prefix, metrics) in PIVOT.items() for m in metrics]
    wide = db.summary_metric.where(F.col("mic").isin(*PIVOT)).groupBy("test_run_id").agg(*picks)
    return runs_by_year(db).join(wide, "test_run_id", "left").withColumn("vol_cuin", volume("max_diameter_in", "length_in"))


def v_run(db: Store) -> DataFrame:
    """published_runs with the number of waveforms of each."""
    counts = db.waveform.groupBy("test_run_id").agg(F.count("*").alias("waveform_count"))
    return published_runs(db).join(counts, "test_run_id", "left").withColumn("waveform_count", F.coalesce("waveform_count", F.lit(0).cast("long")))


def v_shot(db: Store) -> DataFrame:
    """A row for each waveform that has metrics."""
    waves = db.waveform.select(F.col("id").alias("waveform_id"), "test_run_id", "mic", "shot", "excluded", "captured_at", "overload")
    shots = waves.join(db.shot_metric.select("waveform_id", *SHOT_METRICS), "waveform_id")
    return shots.join(runs_by_year(db).select("year", "test_run_id", "event_label", "manufacturer", "suppressor", "caliber", "cartridge"), "test_run_id")


VIEWS = {"v_measurement": v_measurement, "v_run": v_run, "v_shot": v_shot}


def register(db: Store) -> None:
    """The views by name, for spark.sql."""
    for name, view in VIEWS.items():
        view(db).createOrReplaceTempView(name)


def runs(view: DataFrame, **equal: object) -> DataFrame:
    """Rows of a view that equal every value given (year, manufacturer, suppressor, caliber, cartridge ...), in order of year and id."""
    if unknown := set(equal) - set(view.columns):
        raise ValueError(f"no columns {sorted(unknown)}")
    for name, value in equal.items():
        view = view if value is None else view.where(F.col(name) == value)
    return view.orderBy("year", "test_run_id")


def waveforms(index: DataFrame, run: int, mic: str | None = None, shot: int | None = None) -> DataFrame:
    """The waveforms of a run, by microphone and shot."""
    out = index.where(F.col("test_run_id") == run)
    out = out if mic is None else out.where(F.col("mic") == mic)
    return (out if shot is None else out.where(F.col("shot") == shot)).orderBy("mic", "shot")


def waveform_index(db: Store, **equal: object) -> DataFrame:
    """Waveforms without their samples, beside their runs, for the runs that equal the values given."""
    waves = db.waveform.drop("samples").withColumnRenamed("id", "waveform_id")
    some = runs_by_year(db)
    for name, value in equal.items():
        some = some if value is None else some.where(F.col(name) == value)
    return waves.join(some.select("test_run_id", "year", "manufacturer", "suppressor", "caliber", "cartridge"), "test_run_id")


def todo(db: Store, done: DataFrame, year: int | None = None) -> DataFrame:
    """Ids of waveforms that `done` (waveform_id) does not have, of one year or all."""
    left = db.waveform.select(F.col("id").alias("waveform_id"), "test_run_id")
    if year is not None:
        left = left.join(runs_by_year(db).where(F.col("year") == year).select("test_run_id"), "test_run_id", "left_semi")
    return left.join(done.select("waveform_id"), "waveform_id", "left_anti").select("waveform_id")


def with_waveforms(db: Store) -> DataFrame:
    """Runs that are published and have a waveform."""
    published = db.test_run.join(db.summary_metric.select(F.col("test_run_id").alias("id")), "id", "left_semi")
    return published.join(db.waveform.select(F.col("test_run_id").alias("id")), "id", "left_semi")


#: Published metrics of a run whose errors, first-round effects and reductions the catalogue has.
SHOT_LEVELS = METRICS[1:3] + METRICS[4:]


def shot_summaries(db: Store, centres: Column, low_hz: float = 250.0) -> DataFrame:
    """A row for each run with a waveform: how many it has, the standard error of each level of PIVOT's microphones, the first-round effects of SE and ML, and the
    low-frequency level and centroid of their spectra. One aggregate over waveforms, shots and spectra joined by the waveform: averages of a band over
    waveforms, summed over bands, are averages of each waveform's sums, so no band is a row."""
    x = db.waveform.select(F.col("id").alias("waveform_id"), "test_run_id", "mic", "shot", "excluded").join(db.shot_metric.select("waveform_id", *SHOT_LEVELS), "waveform_id", "left")
    counted = lambda mic, c: F.when((F.col("mic") == mic) & ~F.col("excluded") & F.col(c).isNotNull(), F.col(c))
    aggs = [F.count("*").alias("waveform_count")]
    for mic, (prefix, metrics) in PIVOT.items():
        aggs += [(F.stddev_samp(counted(mic, m)) / F.sqrt(F.count(counted(mic, m)))).alias(f"{prefix}_{m}_sem") for m in metrics]
    for mic in ("SE", "ML"):
        v, shot = counted(mic, "peak_dba"), F.when(counted(mic, "peak_dba").isNotNull(), F.col("shot"))
        pop = F.min_by(v, shot) - (F.sum(v) - F.min_by(v, shot)) / F.when(F.count(v) >= 2, F.count(v) - 1)
        aggs.append(F.when(F.min(shot) == 1, pop).alias(f"{mic.lower()}_first_round_pop"))
    if db.band_level is not None:
        pairs = F.transform(F.arrays_zip(F.col("levels").alias("l"), centres.alias("c")), lambda b: F.struct(b["c"].alias("c"), F.when(F.isnan(b["l"]) | b["l"].isNull(), 0.0).otherwise(F.pow(F.lit(10.0), b["l"] / 10)).alias("p")))
        total = lambda f: F.aggregate("_pairs", F.lit(0.0), lambda a, b: a + f(b))
        sums = {"low": total(lambda b: F.when(b["c"] <= low_hz, b["p"]).otherwise(0.0)), "whole": total(lambda b: b["p"]), "moment": total(lambda b: b["c"] * b["p"])}
        x = x.join(db.band_level.withColumn("_pairs", pairs).select("waveform_id", *(c.alias(k) for k, c in sums.items())), "waveform_id", "left")
        for mic in ("SE", "ML"):
            low = F.avg(counted(mic, "low"))
            aggs.append(F.when(low > 0, 10 * F.log10(low)).alias(f"{mic.lower()}_low_freq_db"))
        aggs.append(F.try_divide(F.avg(counted("SE", "moment")), F.avg(counted("SE", "whole"))).alias("se_centroid_hz"))
    return x.groupBy("test_run_id").agg(*aggs)


def catalogue(db: Store, hosts: DataFrame, caveats: DataFrame, centres: Column) -> DataFrame:
    """v_run with the attributes of its host, the standard error of each published metric, the first-round effect, reductions against the baseline,
    spectral scalars, what was said against the run, and the device's key. hosts (cartridge, barrel_in, grains, cycling, platform, subsonic) and caveats
    (year, cartridge, summary) are curated tables of some tens of rows. Everything measured is aggregated once, by run, before it meets the runs."""
    base = kept(published_runs(db), "published")  # read twice
    pairs = {f"{m.lower()}_reduction_{name}": f"{m.lower()}_{metric}" for metric, name in (("peak_dba", "dba"), ("peak_db", "db")) for m in ("SE", "ML")}
    has = lambda c: F.when(F.col(c).isNotNull(), F.col("test_run_id"))
    references = base.where("is_baseline").groupBy("year", "cartridge").agg(*(F.max_by(c, has(c)).alias(f"_{c}") for c in pairs.values()))
    out = base.join(shot_summaries(db, centres), "test_run_id", "left").withColumn("waveform_count", F.coalesce("waveform_count", F.lit(0).cast("long")))
    known = hosts.select("cartridge", F.col("barrel_in").alias("host_barrel_in"), F.col("grains").alias("host_grains"), F.col("cycling").alias("host_cycling"), F.col("platform").alias("host_platform"), ammo(F.col("subsonic")).alias("host_ammo"))
    out = out.join(references, ["year", "cartridge"], "left").withColumns({name: F.when(~F.col("is_baseline"), F.col(f"_{c}") - F.col(c)) for name, c in pairs.items()}).drop(*(f"_{c}" for c in pairs.values()))
    out = out.join(F.broadcast(known), "cartridge", "left").join(F.broadcast(caveat_flags(caveats)), ["year", "cartridge"], "left")
    return out.withColumn("can", N.device_key("manufacturer", "suppressor"))


def ammo(subsonic: Column) -> Column:
    """subsonic, supersonic, or null where it isn't known."""
    return F.when(subsonic, "subsonic").when(~subsonic, "supersonic")


def caveat_flags(caveats: DataFrame) -> DataFrame:
    """(year, cartridge, caveat): the summaries that apply to a run, whatever the microphone."""
    return caveats.groupBy("year", "cartridge").agg(F.array_join(F.array_sort(F.collect_set("summary")), "; ").alias("caveat"))


def caveat_mask(shots: DataFrame, caveats: DataFrame) -> DataFrame:
    """shots (year, cartridge, mic, ...) with the severity of what was said about just that microphone, or null. caveats: year, cartridge, mics, severity."""
    each = caveats.select("year", "cartridge", F.explode("mics").alias("mic"), "severity").groupBy("year", "cartridge", "mic").agg(F.min("severity").alias("severity"))
    return shots.join(F.broadcast(each), ["year", "cartridge", "mic"], "left")


def host_tiers(rows: DataFrame, host: str, year: str, is_baseline: str, labels: DataFrame, first_year: int, rankable: int = 4) -> DataFrame:
    """For each host with a run that is no baseline: runs, years, and from labels (host, label, and further columns such as description and kind) its label (the host's own name
    where there is none) and the rest; its tier (`regular` if tested in several years, `first` if only in first_year, else `other`), whether it has enough runs
    to rank, its place in the tier (most runs first, then by label, then by host), and for a regular host the earlier host of first_year that is the same
    setup: the one with its label and the year in brackets behind it."""
    own = rows.where(~F.col(is_baseline)).groupBy(host).agg(F.count("*").alias("runs"), F.array_sort(F.collect_set(year)).alias("years"))
    named = own.join(labels, host, "left").withColumn("label", F.coalesce("label", F.col(host).cast("string")))
    tier = F.when(F.size("years") > 1, "regular").when(F.get("years", F.lit(0)) == first_year, "first").otherwise("other")
    x = named.withColumns({"tier": tier, "rankable": F.col("runs") >= rankable, "_more": -F.col("runs")})
    x = numbered(x, ["_more", "label", host], "place", group=["tier"]).drop("_more")
    ending = f" ({first_year})"
    old = x.where((F.col("tier") == "first") & F.col("label").endswith(ending)).select(F.col(host).alias("earlier"), F.col("runs").alias("earlier_runs"), F.expr(f"left(label, length(label) - {len(ending)})").alias("label"), F.lit("regular").alias("tier"))
    old = old.groupBy("label", "tier").agg(F.min_by(F.struct("earlier", "earlier_runs"), "earlier").alias("_o"))
    more = [c for c in labels.columns if c not in (host, "label")]
    return x.join(old, ["label", "tier"], "left").select(host, "label", *more, "runs", "years", "tier", "place", "rankable", F.col("_o.earlier").alias("earlier"), F.col("_o.earlier_runs").alias("earlier_runs"))


def coverage(rows: DataFrame, by: str, distinct: dict[str, list[str]], count: str = "runs") -> DataFrame:
    """For each value of `by`: rows, and distinct combinations of the columns of each name."""
    return rows.groupBy(by).agg(F.count("*").alias(count), *(F.countDistinct(*cols).alias(name) if len(cols) == 1 else F.countDistinct(F.struct(*cols)).alias(name) for name, cols in distinct.items()))


def waveform_coverage(rows: DataFrame, waves: DataFrame, by: str, run: str, samples: str) -> DataFrame:
    """For each value of `by`: runs with a waveform, waveforms and their samples; values without waveforms stay, with zeros. Waveforms are summed by run
    before they meet the runs."""
    sums = waves.groupBy(run).agg(F.count("*").alias("_n"), F.sum(samples).alias("_s"))
    g = rows.select(run, by).join(sums, run, "left").groupBy(by)
    return g.agg(F.count("_n").alias("runs"), F.coalesce(F.sum("_n"), F.lit(0)).alias("waveforms"), F.coalesce(F.sum("_s"), F.lit(0)).alias("samples"))


def counts_by(rows: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, n, total) in long form, with the total of the row: the order of a printed table is total descending, then row."""
    n = rows.groupBy(row, column).agg(F.count("*").alias("n"))
    return n.join(rows.groupBy(row).agg(F.count("*").alias("total")), row)


def maker_catalogue(rows: DataFrame, maker: str, model: str, year: str, bore: str) -> DataFrame:
    """For each maker: how many models, its years and bores, and how many bores in each year."""
    bores = rows.groupBy(maker, year).agg(F.countDistinct(bore).alias("_n")).groupBy(maker).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(year, "_n")))).alias("bores_by_year"))
    out = rows.groupBy(maker).agg(F.countDistinct(model).alias("models"), F.array_sort(F.collect_set(year)).alias("years"), F.array_sort(F.collect_set(bore)).alias("bores"))
    return out.join(bores, maker)


def facet_counts(rows: DataFrame, host: str, facets: list[str]) -> DataFrame:
    """(host, facet, value, n) for all facets in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets)))
    return rows.select(host, pairs.alias("x")).select(host, "x.*").groupBy(host, "facet", "value").agg(F.count("*").alias("n"))


def mics_of_run(rows: DataFrame, run: str, mic: str, order: list[str] | None = None) -> DataFrame:
    """(run, mics): the microphones of each run in a fixed order, then others by name."""
    place = F.array_position(F.array(*map(F.lit, order or MIC_ORDER)), F.col(mic))
    key = F.struct(F.when(place > 0, place).otherwise(1 << 20).alias("o"), F.col(mic).alias("mic"))
    return rows.where(F.col(mic).isNotNull()).groupBy(run).agg(F.transform(F.array_sort(F.collect_set(key)), lambda x: x.mic).alias("mics"))


def settled_names(rows: DataFrame, maker: str, model: str, year: str, order: str) -> DataFrame:
    """rows with the name they are shown under: the canonical maker and the device's display name."""
    keyed = rows.withColumn("_can", N.device_key(maker, model))
    shown = N.display_names(keyed, ["_can"], model, year, order)
    return keyed.join(shown, "_can", "left").withColumn("full_name", N.full_name(N.canonical_maker(maker), F.coalesce("display_name", model))).drop("_can")


def device_search(rows: DataFrame, query: str, maker: str, model: str, is_baseline: str, limit: int = 8) -> DataFrame:
    """Devices of which every word of the query is in "maker model": those whose model begins with a word first, then by runs, then by name. An empty query
    finds nothing."""
    words = query.lower().split()
    rows = rows.where(~F.col(is_baseline))
    if not words:
        rows = rows.limit(0)
    name = F.lower(F.concat_ws(" ", maker, model))
    for w in words:
        rows = rows.where(F.contains(name, F.lit(w)))
    prefix = reduce(Column.__or__, (F.lower(F.col(model)).startswith(w) for w in words), F.lit(False))
    return rows.groupBy(maker, model).agg(F.count("*").alias("runs"), F.max(prefix).alias("prefix")).orderBy(F.desc("prefix"), F.desc("runs"), model, maker).limit(limit)


def option_search(rows: DataFrame, column: str, text: str, chosen: list[str], limit: int = 8) -> DataFrame:
    """Values that hold the text and are not chosen yet, most frequent first."""
    return rows.where(F.contains(F.lower(F.col(column)), F.lit(text.lower())) & ~F.col(column).isin(chosen)).groupBy(F.col(column).alias("option")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "option").limit(limit)


def compared(rows: DataFrame, run: str, host: str, year: str, measures: dict[str, str]) -> DataFrame:
    """(measure, run, value, best, mixed_hosts, mixed_years) of two to four runs: the best of a measure (name -> min or max) is marked only if all runs have
    one host and at least two of them a finite value."""
    facts = rows.agg((F.countDistinct(host) > 1).alias("mixed_hosts"), (F.countDistinct(year) > 1).alias("mixed_years"))
    cell = lambda m, b: F.struct(F.lit(m).alias("measure"), F.lit(b).alias("better"), F.col(m).cast("double").alias("value"))
    long = rows.select(F.col(run).alias("run"), F.explode(F.array(*(cell(m, b) for m, b in measures.items()))).alias("x")).select("run", "x.*")
    finite = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
    top = long.groupBy("measure").agg(F.count(finite).alias("_n"), F.max(F.when(F.col("better") == "max", finite).otherwise(-finite)).alias("_top"))
    x = same(same(long, top, ["measure"]), facts, [])
    best = ~F.col("mixed_hosts") & (F.col("_n") >= 2) & (F.when(F.col("better") == "max", F.col("value")).otherwise(-F.col("value")) == F.col("_top"))
    return x.select("measure", "run", "value", F.coalesce(best, F.lit(False)).alias("best"), "mixed_hosts", "mixed_years")


def first_captures(rows: DataFrame, keys: list[str], shot: str, excluded: str) -> DataFrame:
    """The first shot's capture of each run and microphone; an excluded one only where there is no other."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(excluded, shot)).alias("_x"))
    return best.select(*keys, *(F.col(f"_x.{c}").alias(c) for c in rest))


def scored_string(rows: DataFrame, run: str, shot: str, excluded: str, start: DataFrame) -> DataFrame:
    """The captures of each run that count, from the shot that start (run, shot) gives on."""
    return rows.where(~F.col(excluded)).join(start.select(run, F.col(shot).alias("_from")), run).where(F.col(shot) >= F.col("_from")).drop("_from")


def error_bars(rows: DataFrame, value: str, sem: str, pad: float = 0.05) -> DataFrame:
    """rows with lo and hi, value minus and plus its error (none counts as zero), and from and to, the padded range of all of them."""
    e = F.coalesce(F.col(sem), F.lit(0.0))
    x = rows.withColumns({"lo": F.col(value) - e, "hi": F.col(value) + e})
    span = x.agg(F.min("lo").alias("_a"), F.max("hi").alias("_b"))
    width = (F.col("_b") - F.col("_a")) * pad
    return same(x, span, []).withColumns({"from": F.col("_a") - width, "to": F.col("_b") + width}).drop("_a", "_b")


def display_number(x: Column, places: int = 2, sign: bool = False, minus: str = "−", missing: str = "—") -> Column:
    """Fixed places, a true minus sign, a dash where there is no finite number, and no sign before what is printed as zero. What is rounded is the number that the double
    is, a half of it away from zero: 1.005 lies below its decimals and gives 1.00. Its product with a power of ten is taken apart into two doubles without
    loss (up to 1e12; larger numbers are printed as they are)."""
    x = x.cast("double")
    size, power = F.abs(x), float(10**places)
    high = size * 134217729.0 - (size * 134217729.0 - size)  # its upper 26 bits
    product = size * power
    lost = (high * power - product) + (size - high) * power
    whole = F.floor(product)
    units = whole + F.when((product - whole - 0.5) + lost >= 0, 1).otherwise(0)
    digits = F.lpad((units % int(power)).cast("string"), places, "0")
    printed = F.concat(F.floor(units / int(power)).cast("string"), F.lit("." if places else ""), digits if places else F.lit(""))
    text = F.when(size < 1e12, printed).otherwise(F.format_string(f"%.{places}f", size))
    zero = text.cast("double") == 0
    signed = F.when((x < 0) & ~zero, F.concat(F.lit(minus), text)).when(F.lit(sign) & ~zero, F.concat(F.lit("+"), text)).otherwise(text)
    return F.when(x.isNotNull() & ~F.isnan(x) & (size != float("inf")), signed).otherwise(missing)


def violations(hosts: DataFrame, caveats: DataFrame, aliases: DataFrame, defects: DataFrame, run_keys: DataFrame, cycling: list[str], platforms: list[str]) -> DataFrame:
    """(violation, key) of the curated tables: a caveat's host that isn't known, an alias of an alias, a word outside the vocabularies, a barrel's source without
    a barrel or the reverse, a label twice, a known-bad cell of a run that isn't there."""
    found = [
        caveats.join(hosts, "cartridge", "left_anti").select(F.lit("caveat of an unknown host"), "cartridge"),
        aliases.join(aliases.select(F.col("alias").alias("maker")), "maker", "left_semi").select(F.lit("alias of an alias"), "alias"),
        hosts.where(F.col("cycling").isNotNull() & ~F.col("cycling").isin(cycling)).select(F.lit("unknown cycling"), "cartridge"),
        hosts.where(F.col("platform").isNotNull() & ~F.col("platform").isin(platforms)).select(F.lit("unknown platform"), "cartridge"),
        hosts.where(F.col("barrel_in").isNull() != F.col("barrel_source").isNull()).select(F.lit("barrel and source differ"), "cartridge"),
        hosts.groupBy("label").count().where("count > 1").select(F.lit("label of several hosts"), "label"),
        defects.join(run_keys, run_keys.columns, "left_anti").select(F.lit("defect of an unknown run"), F.concat_ws("/", *run_keys.columns)),
    ]
    return reduce(DataFrame.union, found).toDF("violation", "key").distinct()


def with_hosts(rows: DataFrame, hosts: DataFrame, key: str, label: str) -> DataFrame:
    """rows with the attributes of their host (a curated table, some tens of rows); an unknown host has nulls, and its code for a label."""
    return rows.join(F.broadcast(hosts), key, "left").withColumn(label, F.coalesce(label, F.col(key).cast("string")))


def dataset_info(rows: DataFrame, year: str, published: Column, value: str) -> DataFrame:
    """For each year: runs, published ones, and the total of a value."""
    return rows.groupBy(year).agg(F.count("*").alias("runs"), F.count_if(published).alias("published"), F.sum(value).alias("total"))


def dataset_totals(rows: DataFrame, waves: DataFrame, year: str, run: str, published: Column, samples: str) -> DataFrame:
    """For each year: runs, published ones, waveforms and their samples. Waveforms are summed by run before they meet the runs."""
    sums = waves.groupBy(run).agg(F.count("*").alias("_n"), F.sum(samples).alias("_s"))
    return rows.join(sums, run, "left").groupBy(year).agg(F.count("*").alias("runs"), F.count_if(published).alias("published"), F.coalesce(F.sum("_n"), F.lit(0)).alias("waveforms"), F.coalesce(F.sum("_s"), F.lit(0)).alias("samples"))


def attribute_categories(rows: DataFrame, attributes: list[str]) -> DataFrame:
    """(attribute, category, n, known): how many rows have each value of each attribute, and how many have any, in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("category")) for a in attributes)))
    n = rows.select(pairs.alias("x")).select("x.*").where("category is not null").groupBy("attribute", "category").agg(F.count("*").alias("n"))
    return n.join(n.groupBy("attribute").agg(F.sum("n").alias("known")), "attribute")


def ingest_observed(files: DataFrame, path: str, kind: str, samples: str, excluded: Column, mic: str, short: str, truncated: str, defects: str) -> DataFrame:
    """Writes parsed files and returns the report of the ingest, one row: files, waveforms, samples, set aside (excluded), void and unrecognised ones, short captures
    and their lengths, truncated and defective ones, channels without a microphone. All but the lengths are counted by the write itself as rows pass; the
    lengths come from the one column of the written table that has them."""
    is_wave = F.col(kind) == "capture"
    seen = Observation()
    counts = {
        "files": F.count("*"), "waveforms": F.count_if(is_wave), "samples": F.sum(F.when(is_wave, F.size(samples)).otherwise(0)), "excluded": F.count_if(is_wave & excluded), "void": F.count_if(F.col(kind) == "void"),
        "warnings": F.count_if(F.col(kind) == "unrecognised"), "short_captures": F.count_if(is_wave & F.col(short)), "truncated": F.count_if(is_wave & F.col(truncated)), "defective": F.count_if(is_wave & (F.size(defects) > 0)), "unknown_signals": F.count_if(is_wave & F.col(mic).isNull()),
    }
    files.withColumn("_length", F.when(is_wave & F.col(short), F.size(samples))).observe(seen, *(c.cast("long").alias(k) for k, c in counts.items())).write.mode("overwrite").parquet(path)
    got = seen.get
    lengths = files.sparkSession.read.parquet(path).where("_length is not null").groupBy("_length").count()
    shapes = lengths.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_length", "count"))), lambda x: F.concat_ws(" x ", x["count"], x["_length"])), ", ").alias("short_lengths"))
    return shapes.select(*(F.lit(got[k] or 0).cast("long").alias(k) for k in counts), "short_lengths")


def ingest_report(captures: DataFrame, kind: str, excluded: Column, run: str) -> DataFrame:
    """For each kind of file: how many, how many are set aside, of how many runs."""
    return captures.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.count_if(excluded).alias("excluded"), F.countDistinct(run).alias("runs"))


def years_of(rows: DataFrame, key: str, year: str) -> DataFrame:
    """(key, years ascending, span)."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(year)).alias("years"), (F.max(year) - F.min(year)).alias("span"))


def spellings(rows: DataFrame, key: str, name: str, host: str) -> DataFrame:
    """For each device: its spellings, how often it was tested, and on how many hosts."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(name)).alias("spellings"), F.count("*").alias("tested"), F.countDistinct(host).alias("hosts"))


def first_record(rows: DataFrame, keys: list[str], order: str, value: str, ok: Column) -> DataFrame:
    """The first record of each key that is without defects."""
    return rows.where(ok).groupBy(*keys).agg(F.min(order).alias(order), F.min_by(value, order).alias(value))


def quietest(rows: DataFrame, level: str, run_id: str, where: Column, n: int = 10) -> DataFrame:
    """The n lowest levels of a selection; missing ones are not ranked."""
    return rows.where(where & F.col(level).isNotNull()).orderBy(level, run_id).limit(n)


def runs_of_device(rows: DataFrame, device: Column, is_baseline: str, year: str, run_id: str) -> DataFrame:
    """Runs of one device, oldest first; baselines are no results."""
    return rows.where(device & ~F.col(is_baseline)).orderBy(year, run_id)


def rank_fractions(ranked: DataFrame, top: float = 0.25) -> DataFrame:
    """ranked (rank, field) with fraction, 0 for the first and 1 for the last, and whether it is in the top share."""
    return ranked.withColumn("fraction", (F.col("rank") - 1) / F.greatest(F.lit(1), F.col("field") - 1)).withColumn("top", F.col("fraction") <= top)


def device_page(ranked: DataFrame, device: Column, run_id: str) -> DataFrame:
    """A device's ranked runs, by their place in the field."""
    return ranked.where(device).orderBy(F.col("rank") / F.col("field"), run_id)


def contiguous_index(rows: DataFrame, run: str) -> DataFrame:
    """(run, first, n): the position of each run's first record, and its records, where records lie in the order of their runs."""
    return prefix_sums(rows.groupBy(run).agg(F.count("*").alias("n")), run, {"n": "first"}).select(run, "first", "n")


def unused_rows(rows: DataFrame, matched: DataFrame, key: str) -> DataFrame:
    """Published rows that no run was matched with."""
    return rows.join(matched.select(key), key, "left_anti")


def united_bands(traces: DataFrame, keys: list[str], column: Column, lo: str, hi: str) -> DataFrame:
    """(keys, col, lo, hi, from_lo, to_hi) over all traces, the last two over all columns of the keys; a column that no trace has is not there. Extents are of united
    bands, of which there are as many as columns."""
    bands = traces.groupBy(*keys, column.alias("col")).agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"))
    return same(bands, bands.groupBy(*keys).agg(F.min("lo").alias("from_lo"), F.max("hi").alias("to_hi")), keys)
