"""Queries of the waveform operators; the records are the embeddings, times 500."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import levels as L
from ..operators import statistics, waveform
from ..operators.offsets import prefix_sums, same
from .registry import query, rounded, shots, table

RATE, SPAN = 40_000.0, 64
DT = 1 / RATE
LONG = "(select vec_id id, label, unnest(range(0, 64)) i, unnest(embedding)::double * 500 p from embeddings)"


def records(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double") * 500).alias("samples"))


def long(s, d):
    return waveform.samples_of(records(s, d), ["id", "label"], p="samples")


#: A sample step at which the window of 64 samples is 1 to 63, or to 50 where it is short, so both ends cut and a half is rounded.
WIDE_DT, SHORT = 0.002, "label % 2 = 0"
WINDOW = f"(select * from {LONG} where i < case when {SHORT} then 50 else 63 end)"


@query("F10_analysis_window", f"""select id, list(round(p, 6) order by i) w from {WINDOW} group by 1""")
def f10(s, d):
    w = waveform.analysis_window(F.col("samples"), WIDE_DT, F.expr(SHORT))
    return records(s, d).select("id", F.transform(w, lambda x: F.round(x, 6)).alias("w"))


@query("F12_instantaneous_level", f"select id, i, round(20 * log10(abs(nullif(p, 0)) / 2e-5), 6) db from {LONG}")
def f12(s, d):
    r = records(s, d).select("id", F.posexplode(L.instantaneous("samples")).alias("i", "db"))
    return rounded(r.withColumn("i", F.col("i").cast("long")), "db")


@query("A04_band_statistics", f"""with b as (select label, i, 1000 * pow(10.0, (i - 40) / 10.0) c, avg(pow(10.0, p / 5 / 10)) w from {LONG} group by all)
    select label, round(10 * log10(sum(w) filter (c <= 250)), 6) low_db, round(sum(c * w) / sum(w), 4) centroid_hz, list(round(10 * log10(w), 6) order by i) spectrum from b group by 1""")
def a04(s, d):
    rows = records(s, d).withColumn("levels", F.transform("samples", lambda x: x / 5))
    out = statistics.band_statistics(rows, ["label"], "levels", L.centres(-40, 23))
    return rounded(rounded(out, "low_db"), "centroid_hz", to=4).withColumn("spectrum", F.transform("spectrum", lambda x: F.round(x, 6)))


@query("C15_per_hertz", f"select id, list(round(p - 10 * log10(1000 * pow(10.0, (i - 40) / 10.0) * (pow(2, 1 / 6.0::double) - pow(2, -1 / 6.0::double))), 6) order by i) hz from {LONG} group by 1")
def c15(s, d):
    return records(s, d).select("id", F.transform(L.per_hertz("samples", L.centres(-40, 23)), lambda x: F.round(x, 6)).alias("hz"))


@query("C16_band_centres", f"select id, i n, round(1000 * pow(10.0, (i - 16) / 10.0), 4) centre, round(p, 5) as level from {LONG} where i < 30")
def c16(s, d):
    """The first levels of every record beside the centres of their bands."""
    pairs = F.posexplode(F.arrays_zip(L.centres().alias("c"), F.slice("samples", 1, 30).alias("l")))
    return records(s, d).select("id", pairs.alias("n", "x")).select("id", F.col("n").cast("long").alias("n"), F.round("x.c", 4).alias("centre"), F.round("x.l", 5).alias("level"))


DFT = f"""(select id, k, (case when k in (0, 32) then 1 else 2 end) * (pow(sum(p * cos(2 * pi() * k * i / 64)), 2) + pow(sum(p * sin(2 * pi() * k * i / 64)), 2)) / 4096 w from {LONG}, (select unnest(range(0, 33)) k) group by id, k)"""
BANDS = f"""select id, b, round(10 * log10(sum(w) / 4e-10), 5) db from {DFT} join (select b, 1000 * pow(10.0, b / 10.0) c from (select unnest(range(-4, 14)) b)) on k * {RATE} / 64 >= c / pow(2, 1 / 6.0::double) and k * {RATE} / 64 < c * pow(2, 1 / 6.0::double) group by id, b having sum(w) > 0"""


@query("P03_third_octaves", BANDS)
def p03(s, d):
    out = waveform.third_octaves(records(s, d), ["id"], "samples", DT, -4, 13).select("id", F.posexplode("levels").alias("b", "db"))
    return out.where("db is not null").select("id", (F.col("b") - 4).cast("long").alias("b"), F.round("db", 5).alias("db"))


@query("J14_bins_in_bands", f"""select id, b, count(*) bins, round(sum(p), 4) total from {LONG} join (select b, 1000 * pow(10.0, b / 10.0) c from (select unnest(range(-4, 14)) b)) on i <= 32 and i * {RATE} / 64 >= c / pow(2, 1 / 6.0::double) and i * {RATE} / 64 < c * pow(2, 1 / 6.0::double) group by all""")
def j14(s, d):
    """The bins of every record, summed into the bands they fall in; a bin between two centres is in both."""
    centres = 1000 * 10 ** (np.arange(-4, 14) / 10)
    bands = waveform.binned(records(s, d).select("id", F.slice("samples", 1, 33).alias("samples")), ["id"], "samples", centres, RATE / 64)
    x = waveform.samples_of(bands, ["id"], bins="bins", total="total").where("bins > 0")
    return rounded(x.select("id", (F.col("i") - 4).alias("b"), "bins", "total"), "total", to=4)


@query("W08_running_integral", f"select id, i, round(sum(coalesce((p + q) / 2, 0)) over (partition by id order by i), 5) integral from (select id, i, p, lag(p) over (partition by id order by i) q from {LONG})")
def w08(s, d):
    out = waveform.running_integral(records(s, d), ["id"], "samples", 0.001)
    return rounded(waveform.samples_of(out, ["id"], integral="integral"), "integral", to=5)


@query("W09_running_rms", f"select id, i, round(sqrt(avg(p * p) over (partition by id order by i rows between 7 preceding and current row)), 5) rms from (select id, i, p from {LONG} union all select id, i - 64, p from {LONG} where i >= 57) qualify i >= 0")
def w09(s, d):
    out = waveform.running_rms(records(s, d), ["id"], "samples", 8)
    return rounded(waveform.samples_of(out, ["id"], rms="rms"), "rms", to=5)


GAPPY = f"(select id, i, case when (id + i) % 13 in (2, 3) or (id % 5 = 0 and i between 20 and 40) then null else p end p from {LONG})"


@query("W10_gap_fill", f"""with g as (select id, i, p, last_value(case when p is not null then i end ignore nulls) over w a, last_value(p ignore nulls) over w pa, first_value(case when p is not null then i end ignore nulls) over v b, first_value(p ignore nulls) over v pb from {GAPPY} window w as (partition by id order by i rows between unbounded preceding and current row), v as (partition by id order by i rows between current row and unbounded following))
    select id, i, round(case when p is null and b - a <= 9 then pa + (pb - pa) * (i - a) / (b - a) else p end, 5) p from g""")
def w10(s, d):
    hole = lambda i: ((F.col("id") + i) % 13).isin(2, 3) | ((F.col("id") % 5 == 0) & i.between(20, 40))
    gappy = records(s, d).select("id", F.transform("samples", lambda p, i: F.when(~hole(i), p)).alias("samples"))
    return rounded(waveform.samples_of(waveform.gaps_filled(gappy, ["id"], "samples"), ["id"], p="filled"), "p", to=5)


QUANT = f"(select id, i, (round_even(p / s, 0))::bigint q, s from {LONG} join (select id, case when max(abs(p)) > 0 then max(abs(p)) / 32767 else 1 end s from {LONG} group by 1) using (id))"


def quant(s, d):
    scale, q = waveform.quantised(F.col("samples"))
    return records(s, d).select("id", scale.alias("s"), q.alias("q"))


@query("P06_quantised", f"select id, i, q, round(s, 9) s from {QUANT}")
def p06(s, d):
    return waveform.samples_of(quant(s, d), ["id", "s"], q="q").select("id", "i", "q", F.round("s", 9).alias("s"))


@query("W11_differences", f"select id, i, d - coalesce(lag(d) over (partition by id order by i), 0) q from (select id, i, q - coalesce(lag(q) over (partition by id order by i), 0) d from {QUANT})")
def w11(s, d):
    return waveform.samples_of(quant(s, d).select("id", waveform.differences(F.col("q"), 2).alias("q")), ["id"], q="q")


@query("W11_restored", f"select id, i, q from {QUANT}")
def w11b(s, d):
    r = quant(s, d).select("id", waveform.differences(F.col("q"), 2).alias("q"))
    return waveform.samples_of(waveform.restored(r, ["id"], "q", 2), ["id"], q="codes")


#: Parameters of a block around the logarithm of its mean.
NEAR = "k >= greatest(0, floor(log2(m + 1)) - 3) and k <= floor(log2(m + 1)) + {above}"
RICE = f"""(with z as (select id, i // 16 block, case when q >= 0 then 2 * q else -2 * q - 1 end z from {QUANT}), c as (select id, block, k, (sum(z >> k) + count(*) * (k + 1))::bigint bits, avg(z) m from z, (select unnest(range(0, 41))::int k) group by id, block, k)
    select id, block, arg_min(k, bits * 100 + k) k, min(bits) bits from c where {NEAR.format(above=3)} group by id, block)"""


@query("P04_rice_cost", f"select id, block, k, bits from {RICE}")
def p04(s, d):
    x = waveform.samples_of(waveform.rice_bits(quant(s, d), ["id"], "q", 16), ["id"], k="k", bits="bits")
    return x.select("id", F.col("i").alias("block"), F.col("k").cast("int").alias("k"), "bits")


@query("A21_encoding_cost", f"select 'int16' encoding, round(avg(b) / 8 / 64, 6) bytes_per_sample from (select id, sum(bits) b from {RICE} group by 1)")
def a21(s, d):
    bits = waveform.rice_bits(quant(s, d), ["id"], "q", 16).select(F.aggregate("bits", F.lit(0).cast("long"), lambda a, x: a + x).alias("b"))
    return bits.agg(F.lit("int16").alias("encoding"), F.round(F.avg("b") / 8 / 64, 6).alias("bytes_per_sample"))


COSTS = f"""(with s as (select id, i, p, max(abs(p)) over (partition by id) m from {LONG}), e as (select id, i, 'int16' encoding, round_even(p / (m / 32767), 0)::bigint q from s union all select id, i, 'int24', round_even(p / (m / 8388607), 0)::bigint from s),
    d0 as (select id, encoding, i, 0 o, q from e), {", ".join(f"d{o} as (select id, encoding, i, {o} o, q - coalesce(lag(q) over (partition by id, encoding order by i), q) q from d{o - 1})" for o in range(1, 5))},
    z as (select id, encoding, o, i // 16 block, case when q >= 0 then 2 * q else -2 * q - 1 end z from ({" union all ".join(f"select * from d{o}" for o in range(5))})),
    c as (select id, encoding, o, block, k, sum(z >> k) + count(*) * (k + 1) bits, avg(z) m from z, (select unnest(range(0, 41))::int k) group by id, encoding, o, block, k), b as (select id, encoding, o, block, min(bits) bits from c where {NEAR.format(above=3)} group by id, encoding, o, block)
    select id, encoding, o as "order", count(*) blocks, ceil(sum(bits + 8) / 8)::bigint bytes from b group by all)"""
BEST = f"(select *, row_number() over (partition by id, encoding order by bytes, \"order\") r from {COSTS})"


def costs(s, d):
    return waveform.encoding_costs(records(s, d), ["id"], "samples", block=16)


@query("P04_encoding_costs", f"""select id, encoding, "order", blocks, bytes from {COSTS}""")
def p04b(s, d):
    return costs(s, d).select("id", "encoding", F.col("order").cast("long").alias("order"), "blocks", "bytes")


@query("A21_encoding_costs", f"select encoding, round(avg(bytes / 64.0), 6) bytes_per_sample, round(avg(bytes / 128.0), 6) of_raw16 from {BEST} where r = 1 group by 1 union all select 'int16 raw', 2, 1")
def a21b(s, d):
    best = waveform.best_orders(costs(s, d), ["id"]).groupBy("encoding").agg(F.round(F.avg(F.col("bytes") / F.col("n")), 6).alias("bytes_per_sample"), F.round(F.avg(F.col("bytes") / F.col("n") / 2), 6).alias("of_raw16"))
    raw = records(s, d).groupBy().agg(F.count("*").alias("n")).where("n > 0").select(F.lit("int16 raw").alias("encoding"), F.lit(2.0).alias("bytes_per_sample"), F.lit(1.0).alias("of_raw16"))
    return best.union(raw)


@query("A21_best_orders", f"""select encoding, "order", count(*) n from {BEST} where r = 1 group by all""")
def a21c(s, d):
    return waveform.best_orders(costs(s, d), ["id"]).groupBy("encoding", F.col("order").cast("long").alias("order")).agg(F.count("*").alias("n"))


#: Records with one sharp peak each, so that the bound of the unary run matters.
SPIKY = f"(select id, label, i, p * pow(p / 265, 8) p from {LONG})"
FRAMES = f"""(with m as (select *, max(abs(p)) over (partition by id) top from {SPIKY}), q as (select id, i, round_even(p / case when top > 0 then top / 32767 else 1 end, 0)::bigint q from m),
    r as (select id, i, q - 2 * lag(q) over w + lag(q, 2) over w q from q window w as (partition by id order by i) qualify i >= 2), z as (select id, (i - 2) // 32 block, case when q >= 0 then 2 * q else -2 * q - 1 end z from r),
    c as (select id, block, k, (sum(z >> k) + count(*) * (k + 1))::bigint bits, avg(z) m, max(z >> k) longest from z, (select unnest(range(0, 41))::int k) group by id, block, k),
    first as (select id, block, arg_min(k, bits * 100 + k) k from c where {NEAR.format(above=4)} group by id, block),
    b as (select c.id, c.block, arg_min(c.bits, c.k) bits from c join first f on f.id = c.id and f.block = c.block and c.k >= f.k where longest <= 64 or c.k = 40 group by all),
    e as (select id, max(greatest(abs(lo), abs(hi))) e from (select id, ((i + 1) * 10 + 63) // 64 - 1 bucket, min(p) lo, max(p) hi from {SPIKY} group by all) group by 1)
    select id, label, 40::bigint envelope_bytes, (20 + 8 + count(*) + ceil(sum(bits) / 8))::bigint frame_bytes, case when any_value(e) > 0 then any_value(e) / 32767 else 1 end envelope_scale from b join e using (id) join (select vec_id id, label from embeddings) using (id) group by id, label)"""


def frames(s, d):
    spiky = records(s, d).withColumn("samples", F.transform("samples", lambda p: p * F.pow(p / 265, F.lit(8))))
    return waveform.frame_sizes(spiky, ["id"], "samples", block=32, buckets=10)


@query("X03_stored_sizes", f"""with z as {FRAMES} select id, label, envelope_bytes, frame_bytes, (coalesce(sum(frame_bytes) over (order by id rows between unbounded preceding and 1 preceding), 0))::bigint "offset", (sum(frame_bytes) over ())::bigint total from z""")
def x03b(s, d):
    """Sizes of every record's frame, its place among all, and the sum that the places must end at."""
    sizes = frames(s, d).select("id", "envelope_bytes", "frame_bytes").join(records(s, d).select("id", F.col("label").cast("long").alias("label")), "id")
    total = sizes.agg(F.sum("frame_bytes").alias("total"))
    return same(prefix_sums(sizes, "id", {"frame_bytes": "offset"}), total, [])


@query("X03_index_in_order", f"""with z as (select *, label::bigint run, 'mic ' || (id % 4) mic, id // 4 shot from {FRAMES}), w as (select *, row_number() over (order by run, mic, shot, id) - 1 place from z)
    select id, run, mic, shot, 64::bigint n, round(envelope_scale, 9) envelope_scale, frame_bytes, place, place * 40 envelope_at, (coalesce(sum(frame_bytes) over (order by place rows between unbounded preceding and 1 preceding), 0))::bigint frame_at, min(place) over (partition by run) run_first, count(*) over (partition by run) run_count from w""")
def x03c(s, d):
    """The index of all waveforms: sizes, scales and places in the order of run, microphone and shot."""
    rows = records(s, d).select("id", F.col("label").cast("long").alias("run"), F.concat(F.lit("mic "), (F.col("id") % 4).cast("string")).alias("mic"), F.floor(F.col("id") / 4).alias("shot"))
    out = waveform.waveform_places(rows, frames(s, d), "id", "run", "mic", "shot")
    return rounded(out.select("id", "run", "mic", "shot", "n", "envelope_scale", "frame_bytes", "place", "envelope_at", "frame_at", "run_first", "run_count"), "envelope_scale", to=9)


@query("P07_envelope", f"select id, (((i + 1) * 10 + 63) // 64 - 1) bucket, round(min(p), 6) lo, round(max(p), 6) hi from {LONG} group by all")
def p07(s, d):
    x = waveform.samples_of(waveform.envelope(records(s, d), ["id"], "samples", 10), ["id"], lo="lo", hi="hi")
    return rounded(x.withColumnRenamed("i", "bucket"), "lo", "hi")


DECIMATED = """with c as (select col, greatest(floor({t0} + col * {step}), 0) a, ceil({t0} + (col + 1) * {step}) b from (select unnest(range(0, {cols})) col))
    select id, col, round(min(p), 6) lo, round(max(p), 6) hi from {long}, c where b > 0 and floor({t0} + col * {step}) < 64 and i >= a and i < greatest(b, a + 1) group by all"""


def columns_of(s, d, t0, t1, cols):
    x = waveform.samples_of(waveform.decimated(records(s, d), ["id"], "samples", t0, t1, cols, 1.0), ["id"], lo="lo", hi="hi")
    return rounded(x.withColumnRenamed("i", "col").where("lo is not null"), "lo", "hi")


@query("P08_decimated", DECIMATED.format(t0=5, step="(37 / 7.0::double)", cols=7, long=LONG))
def p08(s, d):
    return columns_of(s, d, 5.0, 42.0, 7)


@query("P08_decimated_aligned", DECIMATED.format(t0=-8, step="8.0::double", cols=12, long=LONG))
def p08b(s, d):
    """Columns of eight whole samples, the first before the record and the last ones after it."""
    return columns_of(s, d, -8.0, 88.0, 12)


@query("P09_triggers", f"select id, min(i) filter (p > 80) as trigger from {LONG} group by 1")
def p09(s, d):
    return records(s, d).select("id", waveform.trigger("samples", 80.0).alias("trigger"))


ENVELOPE = f"(select id, label, (((i + 1) * 10 + 63) // 64 - 1) bucket, max(p) hi from {LONG} group by all)"
FIRST_BUCKET = f"(select id, label, min(bucket) filter (hi > least(80, peak / 5)) as trigger from (select *, max(hi) over (partition by id) peak from {ENVELOPE}) group by all)"


def envelope_triggers(s, d):
    return waveform.envelope(records(s, d), ["id", "label"], "samples", 10).select("id", "label", waveform.envelope_trigger("hi", 80.0).alias("trigger"))


@query("P09_envelope_triggers", f"select id, trigger from {FIRST_BUCKET}")
def p09b(s, d):
    return envelope_triggers(s, d).select("id", "trigger")


VIEWS = f"""(with t as (select label, min(trigger * 0.0064::double + 0.001::double) t, 0.001::double lo, 0.065::double hi from {FIRST_BUCKET} group by 1)
    select label, coalesce(greatest(lo, t - 0.0015::double), lo) a, coalesce(least(hi, greatest(lo, t - 0.0015::double) + 0.024::double), hi) b, lo, hi from t)"""


def views(s, d):
    at = envelope_triggers(s, d).select("label", (F.col("trigger") * 0.0064 + 0.001).alias("trigger"), F.lit(0.001).alias("lo"), F.lit(0.065).alias("hi"))
    return waveform.auto_window(at, "label")


@query("P10_auto_window", f"""select label, round(a, 6) "from", round(b, 6) "to" from {VIEWS}""")
def p10(s, d):
    return rounded(views(s, d), "from", "to").select("label", "from", "to")


@query("P10_widened_view", f"""with m as (select label, min(arg_max) - 0.002 a, max(arg_max) + 0.002 b from (select id, label, arg_max(i, p) * 0.001::double + 0.001::double arg_max from {LONG} group by all) group by 1),
    v as (select label, least(v.a, m.a) a, greatest(v.b, m.b) b, lo, hi from {VIEWS} v join m using (label)), l as (select *, least(greatest(b - a, 0.00005), hi - lo) n from v)
    select label, round(least(greatest(a, lo), hi - n), 6) "from", round(least(greatest(a, lo), hi - n) + n, 6) "to" from l""")
def p10b(s, d):
    """The view reaches the peak of each record."""
    marks = long(s, d).groupBy("id", "label").agg((F.max_by("i", F.struct("p", -F.col("i"))) * 0.001 + 0.001).alias("time"))
    return rounded(waveform.widened(views(s, d), marks, "label", "time"), "from", "to")


@query("P12_aligned_overlay", f"""with t as (select id, min(i) k from {LONG} where p > 80 group by 1) select id, i - k as "at", round(p, 6) p from {LONG} join t using (id) where i - k between -2 and 10""")
def p12(s, d):
    overlay = records(s, d).select("id", waveform.aligned_overlay("samples", waveform.trigger("samples", 80.0), 2, 10).alias("o"))
    return rounded(overlay.select("id", F.inline("o")), "p")


@query("P14_set_gain", f"select id, round(0.5 / max(m) over (partition by label), 9) gain from (select id, label, max(abs(p)) m from {LONG} group by all)")
def p14(s, d):
    return rounded(waveform.shared_gain(records(s, d), ["id"], ["label"], "samples"), "gain", to=9)


@query("P14_faded", f"select id, list(round(p * least(1, i / 8.0::double, (63 - i) / 8.0::double) + 0.0::double, 6) order by i) samples from {LONG} group by 1")
def p14b(s, d):
    return records(s, d).select("id", F.transform(waveform.faded(F.col("samples"), 8), lambda x: F.round(x, 6)).alias("samples"))


def response(n: int = 64) -> list[float]:
    """The filter's answer to a single one, from which SQL gets the weighted record by convolution."""
    return waveform.weighted_by_a(np.eye(1, n), 1 / WIDE_DT)[0].tolist()


def curves(rows: str, anyway: bool = False) -> str:
    """CTEs: w, the windowed records with their running integral, weighted samples and running level; m, one row of metrics for each id. At 500 Hz the
    peak is sought in 38 samples and the level in 13 more, and the level runs over 5. Where nothing
    triggers there is no level; with anyway it is sought in the whole record."""
    start, stop = "min(i) filter (p > 1)", "least(min(i) filter (p > 1) + 13, any_value(n) - 1)"
    start, stop = (f"coalesce({start}, 0)", f"case when {start} is null then any_value(n) - 1 else {stop} end") if anyway else (start, f"case when {start} is not null then {stop} end")
    h = ", ".join(f"({k}, {v!r}::double)" for k, v in enumerate(response()))
    return f"""with recursive h(k, v) as (values {h}), x as (select id, i, p, max(i) over (partition by id) + 1 n, sum(coalesce((p + q) / 2, 0)) over (partition by id order by i) * 2 integral from (select id, i, p, lag(p) over (partition by id order by i) q from {rows})),
    y as (select a.id, a.i, sum(v * b.p) y from x a join h on k <= a.i join x b on b.id = a.id and b.i = a.i - k group by all),
    l as (select id, i, sqrt(avg(y * y) over (partition by id order by i rows between 4 preceding and current row)) level from (select id, i, y from y union all select id, i - n, y from y join (select distinct id, n from x) using (id) where i >= n - 4) qualify i >= 0),
    w as (select * from x join y using (id, i) join l using (id, i)),
    t as (select id, any_value(n) n, max(p) filter (i < 38) peak_pa, arg_max(i, p) filter (i < 38) peak_index, arg_min(i, integral) filter (i < 38) trough_index, max(y) filter (i < 38) peak_a_pa, count(*) filter (p > 1) > 0 triggered, {start} leq_start, {stop} leq_stop from w group by 1),
    m as (select id, peak_pa, peak_a_pa, max(integral) filter (i <= trough_index) impulse_pa_ms, max(level) filter (i between leq_start and leq_stop) peak_leq_pa, any_value(peak_index) peak_index, any_value(trough_index) trough_index, arg_max(i, integral) filter (i <= trough_index) impulse_index, any_value(leq_start) leq_start, any_value(leq_stop) leq_stop, arg_max(i, level) filter (i between leq_start and leq_stop) leq_index, any_value(triggered) triggered from w join t using (id) group by id, peak_pa, peak_a_pa)"""


LEVELS = {"peak_db": "peak_pa", "peak_dba": "peak_a_pa", "impulse_db_ms": "impulse_pa_ms", "peak_leq10ms_dba": "peak_leq_pa"}


def db(x: str) -> str:
    return f"case when {x} > 0 then 20 * log10({x} / 2e-5) end"


def metrics(s, d):
    return waveform.shot_metrics(records(s, d), ["id"], "samples", WIDE_DT, short=F.expr(SHORT))


@query("P01_shot_metrics", f"{curves(WINDOW)} select id, {', '.join(f'round({x}, 5) {x}' for x in LEVELS.values())}, {', '.join(f'round({db(x)}, 4) {k}' for k, x in LEVELS.items())} from m")
def p01(s, d):
    out = metrics(s, d).select("id", *LEVELS.values(), *LEVELS)
    return rounded(rounded(out, *LEVELS.values(), to=5), *LEVELS, to=4)


@query("P02_a_weighted", f"{curves(WINDOW)} select id, round(peak_a_pa, 5) peak_a_pa, round({db('peak_a_pa')}, 4) peak_dba from m")
def p02(s, d):
    return rounded(rounded(metrics(s, d).select("id", "peak_a_pa", "peak_dba"), "peak_a_pa", to=5), "peak_dba", to=4)


#: Some records are too quiet to trigger.
QUIET = f"(select * replace (case when label = 7 then p / 300 else p end as p) from {WINDOW})"


def quiet(s, d):
    return records(s, d).withColumn("samples", F.when(F.col("label") == 7, F.transform("samples", lambda x: x / 300)).otherwise(F.col("samples")))


@query("P11_analysis_working", f"{curves(QUIET, True)} select id, peak_index, trough_index, impulse_index, leq_start, leq_stop, leq_index, triggered, round(peak_leq_pa, 5) peak_leq_pa from m")
def p11(s, d):
    found = waveform.shot_metrics(quiet(s, d), ["id"], "samples", WIDE_DT, short=F.expr(SHORT), anyway=True)
    return rounded(found.select("id", *(F.col(c).cast("long").alias(c) for c in waveform.INDICES), "triggered", "peak_leq_pa"), "peak_leq_pa", to=5)


CURVE_ROWS = f"{curves(WINDOW)} select id, i, round(p, 5) pressure, round(y, 5) weighted, round(integral, 5) integral, round(level, 5) running from w"


@query("P11_curves", CURVE_ROWS)
def p11b(s, d):
    """The working behind the metrics, a row for each sample of each record's window."""
    window = waveform.analysis_window(F.col("samples"), WIDE_DT, F.expr(SHORT))
    lists = waveform.curves(records(s, d), ["id"], window, WIDE_DT)
    return rounded(waveform.samples_of(lists, ["id"], **{c: c for c in waveform.CURVES}), *waveform.CURVES, to=5)


@query("P11_curves_in_sql", CURVE_ROWS)
def p11c(s, d):
    """The same from SQL, by the registered function."""
    waveform.register_curves(s)
    window = waveform.analysis_window(F.col("samples"), WIDE_DT, F.expr(SHORT))
    records(s, d).select("id", window.alias("samples")).createOrReplaceTempView("windows")
    return rounded(s.sql(f"select id, c.* from windows lateral view inline(shot_curves(samples, {WIDE_DT}D)) c"), *waveform.CURVES, to=5)


#: The low pass as arithmetic: a sinc that cuts at 0.8 of the new Nyquist frequency, under a Blackman window of 63 taps, with a sum of one.
TAPS = """(select k, v / sum(v) over () v from (select k, (case when k = 31 then 0.16 else sin(0.16 * pi() * (k - 31)) / (pi() * (k - 31)) end) * (0.42 - 0.5 * cos(2 * pi() * k / 62) + 0.08 * cos(4 * pi() * k / 62)) v from (select unnest(range(0, 63)) k)))"""


@query("P13_downsampled", f"""select id, o, round(sum(v * p), 6) p from {LONG} join (select unnest(range(0, 12)) o) on true join {TAPS} on k = i - o * 5 + 31 group by all""")
def p13(s, d):
    out = waveform.downsampled(records(s, d), ["id"], "samples")
    return rounded(waveform.samples_of(out, ["id"], p="samples").withColumnRenamed("i", "o"), "p")


def restored_sql(kind: str) -> str:
    top = {"int16": 32767, "int24": 8388607}.get(kind)
    if top:
        return f"(select id, i, label, round_even(p / s, 0) * s p from {WINDOW} join (select id, max(abs(p)) / {top} s from {WINDOW} group by 1) using (id))"
    return f"(select id, i, label, case when p = 0 then p else round_even(p / u, 0) * u end p from (select *, pow(2.0::double, greatest(floor(log2(abs(nullif(p, 0)))), -14) - 10) u from {WINDOW}))"


def round_trip_sql(kind: str) -> str:
    worst = ", ".join(f"round(max(abs({db('a.' + x)} - {db('b.' + x)})), 4) {k}" for k, x in LEVELS.items())
    return f"select '{kind}' quantiser, {worst} from ({curves(WINDOW)} select * from m) a join ({curves(restored_sql(kind))} select * from m) b using (id)"


@query("P15_round_trip", " union all ".join(map(round_trip_sql, ("int16", "int24", "float16"))))
def p15(s, d):
    out = waveform.round_trip_errors(records(s, d), ["id"], "samples", WIDE_DT, F.expr(SHORT))
    return rounded(out, *LEVELS, to=4)
