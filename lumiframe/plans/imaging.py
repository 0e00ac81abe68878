"""Imaging queries on the driver's tables, each with the SQL that must give the same rows.

EMB: ``embeddings`` as a movie of 25 columns; EVT: ``events`` by user and six hours; traces: ``events`` by type and hour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumiframe.operators import denoise, detrend, masks, movie, normalize, order, patches, projections, render, stats, transients

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

EMB = "mv as (select cast(vec_id//25 as int) y, cast(vec_id%25 as int) x, cast(t-1 as int) t, cast(embedding[t] as double) v from embeddings, range(1,65) g(t))"
ROI = "rp as (select cast(label as int) roi, cast(vec_id//25 as int) y, cast(vec_id%25 as int) x from embeddings)"
VOL = "vo as (select cast(vec_id//100 as int) l, cast(vec_id//10%10 as int) w, cast(vec_id%10 as int) d, cast(t-1 as int) t, cast(embedding[t] as double) v from embeddings, range(1,65) g(t))"
EVT = """ev as (select user_id, cast(floor((epoch_us(ts)/1e6-1704067200)/21600) as int) t, sum(value) v from events group by 1,2),
mv as (select cast(u.user_id//10 as int) y, cast(u.user_id%10 as int) x, cast(g.t as int) t, coalesce(e.v,0.0) v from (select distinct user_id from events) u cross join range(0,120) g(t) left join ev e on e.user_id=u.user_id and e.t=g.t)"""
TRACES = """et as (select event_type id, cast(floor((epoch_us(ts)/1e6-1704067200)/3600) as int) t, sum(value) v from events group by 1,2),
tr as (select u.id, cast(g.t as int) t, coalesce(e.v,0.0) v from (select distinct event_type id from events) u cross join range(0,720) g(t) left join et e on e.id=u.id and e.t=g.t)"""
MEAN = "im as (select y, x, avg(v) v from mv group by y, x)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(c="v", digits: int = 6):
    """Rounded, without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def image(df: DataFrame, keys=("y", "x"), digits: int = 6) -> DataFrame:
    return df.select(*keys, *(["t"] if "t" in df.columns else []), r6("v", digits).alias("v"))


def emb(s: SparkSession, d: str) -> DataFrame:
    return movie.embedding_movie(s, d)


def q_image(name: str, source, op, src: str, value: str, keys: str = "y, x", table: str = "mv"):
    QUERIES[name] = lambda s, d: image(op(source(s, d)), tuple(keys.split(", ")))
    ORACLES[name] = f"with {src} select {keys}, round({value}, 6) + 0.0 v from {table} group by {keys}"


# projections
Q50 = "quantile_cont(v, 0.5)"
FANO = "case when avg(v) > 0 then var_pop(v)/avg(v) else 0.0 end"
for tag, source, src in (("emb", emb, EMB), ("evt", movie.event_movie, EVT)):
    q_image(f"p1_mean_{tag}", source, projections.mean, src, "avg(v)")
    q_image(f"p2_median_{tag}", source, projections.median, src, Q50)
    q_image(f"p3_variance_{tag}", source, projections.variance, src, "var_pop(v)")
    q_image(f"p4_fano_{tag}", source, projections.fano_factor, src, FANO)
VK = ("l", "w", "d")
for p, op, value in (("mean", projections.mean, "avg(v)"), ("median", projections.median, Q50), ("variance", projections.variance, "var_pop(v)"), ("fano", projections.fano_factor, FANO)):
    q_image(f"p6_{p}_volume", movie.embedding_volume, lambda m, op=op: op(m, VK), VOL, value, "l, w, d", "vo")

HSM = """with recursive {src}, srt as (select {keys}, list_sort(list(v)) s from {table} group by {keys}),
hs as (select {keys}, s, 0 k from srt union all
  select {keys}, s[i:i+h-1], k+1 from (select {keys}, s, k, h, list_position(list_transform(range(1, len(s)-h+1), lambda j: s[j+h-1]-s[j]), list_min(list_transform(range(1, len(s)-h+1), lambda j: s[j+h-1]-s[j]))) i from (select *, cast(ceil(len(s)/2) as bigint) h from hs where len(s) > 3))),
fin as (select {keys}, s from hs where len(s) <= 3)
select {keys}, round(case when len(s)=1 then s[1] when len(s)=2 then (s[1]+s[2])/2 when s[2]-s[1] < s[3]-s[2] then (s[1]+s[2])/2 when s[2]-s[1] > s[3]-s[2] then (s[2]+s[3])/2 else s[2] end, 6) + 0.0 v from fin"""
QUERIES["p5_mode"] = lambda s, d: image(projections.mode(emb(s, d)))
QUERIES["p5_mode_expression"] = lambda s, d: image(projections.mode_by_expression(emb(s, d)))
QUERIES["p6_mode_volume"] = lambda s, d: image(projections.mode(movie.embedding_volume(s, d), VK), VK)
ORACLES["p5_mode"] = ORACLES["p5_mode_expression"] = HSM.format(src=EMB, keys="y, x", table="mv")
ORACLES["p6_mode_volume"] = HSM.format(src=VOL, keys="l, w, d", table="vo")

LOCAL = """nb as (select a.y, a.x, a.t, a.v own, avg(b.v) nb from mv a join mv b on a.t=b.t and abs(a.y-b.y)<=1 and abs(a.x-b.x)<=1 and not(a.y=b.y and a.x=b.x) group by a.y, a.x, a.t, a.v)"""
for tag, source, src in (("emb", emb, EMB), ("evt", movie.event_movie, EVT)):
    QUERIES[f"p7_local_correlation_{tag}"] = lambda s, d, source=source: image(projections.local_correlation(source(s, d)))
    ORACLES[f"p7_local_correlation_{tag}"] = f"with {src}, {LOCAL} select y, x, round(coalesce(case when isnan(corr(own, nb)) then 0.0 else corr(own, nb) end, 0.0), 6) + 0.0 v from nb group by y, x"

WELCH = """z as (select y, x, t, (v - avg(v) over (partition by y, x)) * (0.5-0.5*cos(2*pi()*t/64)) w from mv),
fq as (select y, x, k, (pow(sum(w*cos(2*pi()*k*t/64)), 2) + pow(sum(w*sin(2*pi()*k*t/64)), 2)) / 24.0 * case when k < 32 then 2 else 1 end p from z, range(16, 33) g(k) group by y, x, k),
ns as (select y, x, exp(avg(ln(p/2 + 1e-10)) / 2) s from fq group by y, x)"""
ORACLES["p9_noise_projection"] = f"with {EMB}, {WELCH} select y, x, round(s, 6) + 0.0 v from ns"
ORACLES["p10_peak_to_noise"] = f"with {EMB}, {WELCH} select y, x, round((max(v) - quantile_cont(v, 0.5)) / greatest(any_value(s), 1e-6), 6) + 0.0 v from mv join ns using (y, x) group by y, x"
QUERIES["p9_noise_projection"] = lambda s, d: image(projections.noise_std(emb(s, d)))
QUERIES["p10_peak_to_noise"] = lambda s, d: image(projections.peak_to_noise(emb(s, d)))
for how, fn in (("max", "max"), ("mean", "avg")):
    QUERIES[f"p11_depth_{how}"] = lambda s, d, how=how: image(projections.depth(movie.embedding_volume(s, d), how), ("l", "w"))
    ORACLES[f"p11_depth_{how}"] = f"with {VOL} select l, w, t, round({fn}(v), 6) + 0.0 v from vo group by l, w, t"
QUERIES["p12_binned_max"] = lambda s, d: image(projections.binned_max(emb(s, d), 50))
ORACLES["p12_binned_max"] = f"with {EMB}, b as (select y, x, t//50 b, avg(v) m from mv where t < 50 group by 1,2,3) select y, x, round(max(m), 6) + 0.0 v from b group by y, x"


@query("b3_global_median", f"with {EMB} select round({Q50}, 6) v, round(var_pop(v), 6) var from mv")
def _(s, d):
    m = emb(s, d)
    return m.agg(r6(F.lit(order.quantile(m))).alias("v"), r6(F.var_pop("v")).alias("var"))


# normalisation
MAD = "0.6741891400433162"


@query("n1_robust_std_pixel", f"with {EMB}, m as (select *, quantile_cont(v, 0.5) over (partition by y, x) m from mv) select y, x, round(quantile_cont(abs(v-m), 0.5)/{MAD}, 6) v from m group by y, x")
def _(s, d):
    return image(normalize.robust_std(emb(s, d), ("y", "x")))


@query("n1_robust_std", f"with {EMB}, m as (select *, quantile_cont(v, 0.5) over () m from mv) select round(quantile_cont(abs(v-m), 0.5)/{MAD}, 6) v from m")
def _(s, d):
    return normalize.robust_std(emb(s, d)).select(r6().alias("v"))


@query("n2_mode_baseline", HSM.format(src=EMB, keys="x", table="mv"))
def _(s, d):
    return normalize._baseline(emb(s, d), "mode", ("x",)).select("x", r6().alias("v"))


_ALL = f"""with recursive {EMB}, rk as (select v, row_number() over (order by v) - 1 i from mv),
hs as (select cast(0 as bigint) b, count(*) n from rk union all
  select arg_min(p.i, struct_pack(w := q.v-p.v, i := p.i)), (n+1)//2 from hs join rk p on p.i >= b and p.i < b+n-(n+1)//2 join rk q on q.i = p.i+(n+1)//2-1 where n > 3 group by n),
fin as (select list(v order by v) s from rk, (select * from hs where n <= 3) where i >= b and i < b+n),
md as (select round(case when len(s)=1 then s[1] when len(s)=2 then (s[1]+s[2])/2 when s[2]-s[1] < s[3]-s[2] then (s[1]+s[2])/2 when s[2]-s[1] > s[3]-s[2] then (s[2]+s[3])/2 else s[2] end, 6) + 0.0 v from fin)"""


@query("n2_mode_baseline_all", f"{_ALL} select v from md")
def _(s, d):
    return normalize._baseline(emb(s, d), "mode", ()).select(r6().alias("v"))


@query("n8_value_marks_all", f"{_ALL} select round(avg(mv.v), 6) + 0.0 mean, round(quantile_cont(mv.v, 0.5), 6) + 0.0 median, any_value(md.v) mode from mv, md")
def _(s, d):
    return normalize.value_marks(emb(s, d)).select(*[r6(c).alias(c) for c in ("mean", "median", "mode")])


@query("n3_baselines_all", f"with {EMB}, c as (select {Q50} c from mv) select round(c, 6) + 0.0 c, round((select quantile_cont(abs(v-c), 0.5)/{MAD} from mv, c), 6) s from c")
def _(s, d):
    c, sc = normalize.baselines(emb(s, d), "median", "robuststd")
    return c.crossJoin(sc).select(r6("c").alias("c"), r6("s").alias("s"))


def _norm_sql(c: str, s: str, pc: bool, ps: bool) -> str:
    agg = {"mean": "avg(v)", "median": Q50, "min": "min(v)", "max": "max(v)"}
    part = lambda k, own, n: f"{n} as (select {'y, x, ' if own else ''}{agg[k]} b from mv{' group by y, x' if own else ''})"
    on = lambda own, n: f"join {n} on {n}.y=mv.y and {n}.x=mv.x" if own else f"cross join {n}"
    return f"with {EMB}, {part(c, pc, 'c')}, {part(s, ps, 's')} select mv.y, mv.x, mv.t, round((mv.v - c.b)/(case when s.b = 0 then 1 else s.b end), 5) + 0.0 v from mv {on(pc, 'c')} {on(ps, 's')}"


for c, sc, pc, ps in (("min", "max", False, False), ("mean", "max", True, False), ("median", "max", True, True), ("min", "mean", False, True)):
    n = f"n5_normalize_{c}_{sc}_{'p' if pc else 'a'}{'p' if ps else 'a'}"
    QUERIES[n] = lambda s, d, a=(c, sc, pc, ps): image(normalize.normalize(emb(s, d), *a), digits=5)
    ORACLES[n] = _norm_sql(c, sc, pc, ps)


@query("n3_baselines", f"with {EMB}, p as (select y, x, {Q50} c, max(v) s from mv group by y, x) select y, x, round(c, 6) + 0.0 c, round(case when s = 0 then 1 else s end, 6) s from p")
def _(s, d):
    c, sc = normalize.baselines(emb(s, d), "median", "max", True, True)
    return c.join(sc, ["y", "x"]).select("y", "x", r6("c").alias("c"), r6("s").alias("s"))


@query("n7_summary", f"with {EMB} select round(min(v), 6) min, round(max(v), 6) max, round(avg(v), 6) + 0.0 mean, round(stddev_pop(v), 6) std from mv")
def _(s, d):
    return normalize.summary(emb(s, d)).select(*[r6(c).alias(c) for c in ("min", "max", "mean", "std")])


@query("n8_histogram", f"with {TRACES}, e as (select min(v) a, max(v) b from tr), h as (select cast(least(floor((v-a)/(b-a)*20), 19) as int) bin, count(*) n from tr, e group by 1) select cast(g.k as int) bin, round(a+(b-a)/20*g.k, 6) lo, coalesce(n, 0)::bigint n from range(0,20) g(k) cross join e left join h on h.bin=g.k")
def _(s, d):
    return normalize.histogram(movie.event_traces(s, d), 20).select("bin", r6("lo").alias("lo"), "n")


_MODE, _PICK = HSM.format(src=TRACES, keys="id", table="tr").rsplit("\nselect", 1)


@query("n8_value_marks", f"{_MODE}, md as (select{_PICK}) select id, round(avg(tr.v), 6) + 0.0 mean, round(quantile_cont(tr.v, 0.5), 6) + 0.0 median, any_value(md.v) mode from tr join md using (id) group by id")
def _(s, d):
    return normalize.value_marks(movie.event_traces(s, d), ("id",)).select("id", *[r6(c).alias(c) for c in ("mean", "median", "mode")])


# masks
def _mask(df: DataFrame, keys=("y", "x")) -> DataFrame:
    return df.select(*keys, F.col("inside").cast("int").alias("inside"))


def mean_image(s, d):
    return projections.mean(emb(s, d))


OTSU = """e as (select min(v) lo, max(v) hi from im), h as (select cast(least(floor((v-lo)/(hi-lo)*256), 255) as int) bin, count(*) n from im, e group by 1),
hb as (select g.k bin, coalesce(n, 0) n, lo+(hi-lo)/256*g.k+(hi-lo)/256/2 c from range(0,256) g(k) cross join e left join h on h.bin=g.k),
cu as (select bin, c, sum(n) over (order by bin) n1, sum(n*c) over (order by bin) s1, sum(n) over () nn, sum(n*c) over () ss from hb),
bw as (select bin, c, case when n1 > 0 and nn-n1 > 0 then n1*(nn-n1)*power(s1/n1-(ss-s1)/(nn-n1), 2) else -1.0 end b from cu), th as (select c thr from bw order by b desc, bin limit 1)"""


@query("m2_otsu_mask", f"with {EMB}, {MEAN}, {OTSU} select y, x, cast(v > thr as int) inside from im, th")
def _(s, d):
    return _mask(masks.otsu_mask(mean_image(s, d)))


@query("m1_triangle_mask")
def _(s, d):
    return _mask(masks.compute(mean_image(s, d), "triangle"))


@query("m3_manual_mask", f"with {EMB}, {MEAN} select y, x, cast(v > 0.0012345 as int) inside from im")
def _(s, d):
    return _mask(masks.above(mean_image(s, d), 0.0012345))


@query("m4_percentile_mask", f"with {EMB}, {MEAN}, th as (select quantile_cont(v, 0.8) thr from im) select y, x, cast(v > thr as int) inside from im, th")
def _(s, d):
    return _mask(masks.percentile_mask(mean_image(s, d), 20))


@query("m6_apply_mask", f"with {EMB}, {MEAN} select mv.y, mv.x, mv.t, round(case when im.v > 0.0012345 then mv.v else 0.0 end, 6) + 0.0 v from mv join im on im.y=mv.y and im.x=mv.x")
def _(s, d):
    m = emb(s, d)
    return image(masks.apply(m, masks.above(projections.mean(m), 0.0012345)))


@query("m7_mask_stage", f"with {EMB}, {MEAN}, {OTSU} select round(avg(cast(v > thr as int)), 6) fraction_kept from im, th")
def _(s, d):
    return masks.stage(emb(s, d), "otsu")[2].select(r6("fraction_kept").alias("fraction_kept"))


@query("m8_disk", "select cast(vec_id//25 as int) y, cast(vec_id%25 as int) x from embeddings where power(vec_id//25-7, 2)+power(vec_id%25-11, 2) <= 20.25")
def _(s, d):
    return masks.disk(emb(s, d).select("y", "x").distinct(), (7, 11), 4.5)


@query("m9_region_traces", f"with {EMB}, {ROI} select roi, t, round(avg(v), 6) + 0.0 v from mv join rp on mv.y=rp.y and mv.x=rp.x group by roi, t")
def _(s, d):
    return masks.region_traces(emb(s, d), movie.embedding_labels(s, d)).select("roi", "t", r6().alias("v"))


@query("m10_region_traces_volume", f"with {VOL}, rv as (select cast(label as int) roi, cast(vec_id//100 as int) l, cast(vec_id//10%10 as int) w, cast(vec_id%10 as int) d from embeddings) select roi, t, round(avg(v), 6) + 0.0 v from vo join rv using (l, w, d) group by roi, t")
def _(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet")
    v = F.col("vec_id")
    rv = e.select(F.col("label").cast("int").alias("roi"), F.floor(v / 100).cast("int").alias("l"), (F.floor(v / 10) % 10).cast("int").alias("w"), (v % 10).cast("int").alias("d"))
    return masks.region_traces(movie.embedding_volume(s, d), rv, VK).select("roi", "t", r6().alias("v"))


@query("m11_threshold_footprints")
def _(s, d):
    fp = movie.embedding_labels(s, d).join(mean_image(s, d), ["y", "x"]).select("roi", "y", "x", F.abs("v").alias("w"))
    return masks.threshold_footprints(fp).select("roi", "y", "x", r6("w").alias("w"))


OFFS = "(values {}) o(dy, dx)"


def _offsets(r: float) -> str:
    from lumiframe.functions.kernels import disk_offsets

    return OFFS.format(", ".join(f"({a},{b})" for a, b in disk_offsets(r)))


@query("x2_dilation", f"with {ROI} select distinct rp.y+dy y, rp.x+dx x from rp, {_offsets(2)} where roi = 3 and rp.x+dx between 0 and 24 and exists (select 1 from rp g where g.y=rp.y+dy and g.x=rp.x+dx)")
def _(s, d):
    from lumiframe.functions.kernels import disk_offsets

    rp = movie.embedding_labels(s, d)
    return masks.dilate(rp.filter("roi = 3"), disk_offsets(2), rp.select("y", "x")).select("y", "x")


RING = f"""far as (select distinct roi, rp.y+dy y, rp.x+dx x from rs rp, {_offsets(4)}), near as (select distinct roi, rp.y+dy y, rp.x+dx x from rs rp, {_offsets(2)}),
ring as (select far.roi, far.y, far.x from far semi join rp g on g.y=far.y and g.x=far.x anti join near on near.roi=far.roi and near.y=far.y and near.x=far.x anti join rs on rs.y=far.y and rs.x=far.x)"""
SMALL = "rs as (select * from rp where (roi = 1 and y between 2 and 5) or (roi = 2 and y between 10 and 13))"


def _small(s, d):
    return movie.embedding_labels(s, d).filter("(roi = 1 and y between 2 and 5) or (roi = 2 and y between 10 and 13)")


@query("x7_neuropil_rings", f"with {ROI}, {SMALL}, {RING} select roi, y, x from ring")
def _(s, d):
    return masks.neuropil_rings(_small(s, d), movie.embedding_labels(s, d).select("y", "x"))


@query("x8_neuropil_traces", f"with {EMB}, {ROI}, {SMALL}, {RING} select roi, t, round(avg(v), 6) + 0.0 v from ring join mv using (y, x) group by roi, t")
def _(s, d):
    return masks.neuropil_traces(emb(s, d), _small(s, d)).select("roi", "t", r6().alias("v"))


@query("x9_region_centres", f"with {ROI}, {EMB}, {MEAN}, fp as (select roi, rp.y, rp.x, abs(v) w from rp join im using (y, x)) select roi, round(sum(w*y)/sum(w), 6) c_y, round(sum(w*x)/sum(w), 6) c_x, min(y) lo_y, min(x) lo_x, max(y) hi_y, max(x) hi_x from fp where w <> 0 group by roi")
def _(s, d):
    fp = movie.embedding_labels(s, d).join(mean_image(s, d), ["y", "x"]).withColumnRenamed("v", "w")
    return masks.centres(fp).select("roi", r6("c_y").alias("c_y"), r6("c_x").alias("c_x"), "lo_y", "lo_x", "hi_y", "hi_x")


@query("x1_components", f"""with recursive {EMB}, {MEAN}, px as (select y, x, row_number() over (order by y, x) id from im where v > 0.05),
e as (select a.id a, b.id b from px a join px b on abs(a.y-b.y)<=1 and abs(a.x-b.x)<=1), reach as (select a, b from e union select r.a, e.b from reach r join e on r.b=e.a),
root as (select a id, min(b) root from reach group by a) select y, x, cast(dense_rank() over (order by root) as int) label from px join root using (id)""")
def _(s, d):
    on = mean_image(s, d).filter("v > 0.05").withColumn("roi", F.lit(0))
    return masks.components(on).select("y", "x", "label")


@query("v5_project_mask", "select distinct cast(vec_id//100 as int) l, cast(vec_id//10%10 as int) w from embeddings where label = 2")
def _(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet").filter("label = 2")
    v = F.col("vec_id")
    return masks.project_mask(e.select(F.floor(v / 100).cast("int").alias("l"), (F.floor(v / 10) % 10).cast("int").alias("w"), (v % 10).cast("int").alias("d")))


# detrending
FIELD = "ft as (select t, avg(v) a from mv group by t), fr as (select t, case when f <> 0 then a/f else a end v from ft cross join (select a f from ft order by t limit 1))"


@query("t1_field_trace", f"with {EVT}, {FIELD} select t, round(v, 6) v from fr")
def _(s, d):
    return detrend.field_trace(movie.event_movie(s, d)).select("t", r6().alias("v"))


@query("t1_field_trace_masked", f"with {EVT}, mm as (select y, x from mv group by y, x having avg(v) > 10), ft as (select t, avg(v) a from mv semi join mm on mm.y=mv.y and mm.x=mv.x group by t), fr as (select t, case when f <> 0 then a/f else a end v from ft cross join (select a f from ft order by t limit 1)) select t, round(v, 6) v from fr")
def _(s, d):
    m = movie.event_movie(s, d)
    return detrend.field_trace(m, masks.above(projections.mean(m), 10).filter("inside")).select("t", r6().alias("v"))


@query("t2_running_percentile", f"with {TRACES} select id, t, round(quantile_cont(v, 0.08) over (partition by id order by t rows between 19 preceding and current row), 6) trend from tr")
def _(s, d):
    return detrend.running_percentile(movie.event_traces(s, d), 8, 20, ("id",)).select("id", "t", r6("trend").alias("trend"))


@query("t3_asymmetric_huber", f"with {EMB}, c as (select y, x, t, v, greatest(least(v, 0.1), -0.3) c from mv) select y, x, t, round(0.5*c*c+c*(v-c), 6) + 0.0 loss, round(c, 6) + 0.0 grad from c")
def _(s, d):
    loss, grad = detrend.asymmetric_huber(F.col("v"), 0.3, 0.1)
    return emb(s, d).select("y", "x", "t", r6(loss).alias("loss"), r6(grad).alias("grad"))


@query("t4_exponential_guess", f"""with {TRACES}, vp as (select id, t, v + 1.0 v from tr), sg as (select id, s, t - s u, v from vp, range(0, 465, 128) g(s) where t between s and s + 255),
z as (select id, s, u, (v - avg(v) over (partition by id, s)) * (0.5-0.5*cos(2*pi()*u/256)) w from sg),
fq as (select id, s, k, (pow(sum(w*cos(2*pi()*k*u/256)), 2) + pow(sum(w*sin(2*pi()*k*u/256)), 2)) / 96.0 * case when k < 128 then 2 else 1 end p from z, range(64, 129) g(k) group by id, s, k),
fm as (select id, k, avg(p) p from fq group by id, k), ns as (select id, exp(avg(ln(p/2 + 1e-10)) / 2) sg from fm group by id),
le as (select id, greatest(3*any_value(sg), greatest(max(v), 1.0)*1e-6) l, max(t) last from vp join ns using (id) group by id), us as (select id, t, v, l, last, count(*) filter (where v > l) over (partition by id) n from vp join le using (id)),
rg as (select id, regr_slope(ln(greatest(v, l)), t) b, regr_intercept(ln(greatest(v, l)), t) a, any_value(l) l, any_value(last) last from us where n < 2 or v > l group by id)
select id, round(greatest(exp(a), l), 4) + 0.0 a, round(case when b < 0 then -1/b else greatest(last, 1.0) end, 2) + 0.0 b from rg""")
def _(s, d):
    return detrend.exponential_guess(movie.event_traces(s, d).withColumn("v", F.col("v") + 1.0), ("id",)).select("id", r6("a", 4).alias("a"), r6("b", 2).alias("b"))


@query("t6_exponential_trend")
def _(s, d):
    return detrend.exponential_trend(movie.event_traces(s, d), ("id",)).select("id", "t", r6("trend", 4).alias("trend"))


@query("t7_detrend", f"with {EVT}, {FIELD}, tt as (select t, quantile_cont(v, 0.5) over (order by t rows between 19 preceding and current row) trend from fr), m as (select avg(trend) m from tt) select y, x, mv.t, round(v/(trend/m), 4) + 0.0 v from mv join tt on tt.t=mv.t cross join m")
def _(s, d):
    return image(detrend.detrend(movie.event_movie(s, d), 50, 20), digits=4)


@query("t8_detrend_exponential")
def _(s, d):
    return image(detrend.detrend_exponential(movie.event_movie(s, d)), digits=4)


# denoising
def _gauss_sql(axis: str, rest: str, sigma: float, border: str = "reflect") -> str:
    from lumiframe.functions.kernels import gaussian_taps

    taps = gaussian_taps(sigma)
    r = len(taps) // 2
    vals = ", ".join(f"({k - r}, {w!r}::double)" for k, w in enumerate(taps))
    at = f"case when (({axis}+o)%(2*n)+2*n)%(2*n) >= n then 2*n-1-(({axis}+o)%(2*n)+2*n)%(2*n) else (({axis}+o)%(2*n)+2*n)%(2*n) end" if border == "reflect" else f"least(greatest({axis}+o, 0), n-1)"
    return f"select a.y, a.x, a.t, sum(k.w*b.v) v from (select p.*, k.o, k.w, {at} z from {{src}} p cross join (select max({axis})+1 n from {{src}}) cross join (values {vals}) k(o, w)) k join {{src}} b on b.{axis}=k.z and {' and '.join(f'b.{c}=k.{c}' for c in rest.split())} join {{src}} a on a.y=k.y and a.x=k.x and a.t=k.t group by a.y, a.x, a.t"


@query("q1_gaussian_time", f"with {EMB}, g as ({_gauss_sql('t', 'y x', 2.0).format(src='mv')}) select y, x, t, round(v, 6) + 0.0 v from g")
def _(s, d):
    return image(denoise.gaussian(emb(s, d), 0, 2.0))


@query("q1_gaussian_space", f"with {EMB}, g1 as ({_gauss_sql('y', 'x t', 1.0).format(src='mv')}), g as ({_gauss_sql('x', 'y t', 1.0).format(src='g1')}) select y, x, t, round(v, 6) + 0.0 v from g")
def _(s, d):
    return image(denoise.gaussian(emb(s, d), 1.0, 0))


QUERIES["q12_blur_movie"], ORACLES["q12_blur_movie"] = QUERIES["q1_gaussian_space"], ORACLES["q1_gaussian_space"]


@query("q13_blur_nearest", f"with {EMB}, g1 as ({_gauss_sql('y', 'x t', 1.0, 'nearest').format(src='mv')}), g as ({_gauss_sql('x', 'y t', 1.0, 'nearest').format(src='g1')}) select y, x, t, round(v, 6) + 0.0 v from g")
def _(s, d):
    return image(denoise.gaussian(emb(s, d), 1.0, 0, border="nearest"))


@query("q2_median_space", f"with {EMB}, h as (select max(y) hy from mv), w as (select a.y, a.x, a.t, b.v from mv a cross join h cross join (values (-1),(0),(1)) p(dy) cross join (values (-1),(0),(1)) q(dx) join mv b on b.t=a.t and b.y=least(greatest(a.y+dy, 0), hy) and b.x=least(greatest(a.x+dx, 0), 24)) select y, x, t, round(list_sort(list(v))[5], 6) + 0.0 v from w group by y, x, t")
def _(s, d):
    return image(denoise.median(emb(s, d), 3, 1))


@query("q2_median_time", f"with {EMB}, w as (select a.y, a.x, a.t, b.v from mv a cross join (values (-2),(-1),(0),(1),(2)) p(dt) join mv b on b.y=a.y and b.x=a.x and b.t=least(greatest(a.t+dt, 0), 63)) select y, x, t, round(list_sort(list(v))[3], 6) + 0.0 v from w group by y, x, t")
def _(s, d):
    return image(denoise.median(emb(s, d), 1, 5))


QUERIES["q3_gaussian_volume"] = lambda s, d: image(denoise.gaussian(movie.embedding_volume(s, d), 0.0, 1.0, VK), VK)
ORACLES["q3_gaussian_volume"] = f"with {VOL}, mv as (select l*1000+w y, d x, t, v from vo), g as ({_gauss_sql('t', 'y x', 1.0).format(src='mv')}) select cast(y//1000 as int) l, cast(y%1000 as int) w, x d, t, round(v, 6) + 0.0 v from g"
QUERIES["q5_wavelet_time"] = lambda s, d: image(denoise.wavelet_time(emb(s, d)), digits=4)
QUERIES["q6_wavelet_space"] = lambda s, d: image(denoise.wavelet_space(emb(s, d), "haar", 2), digits=4)
QUERIES["q7_low_rank"] = lambda s, d: image(denoise.low_rank(emb(s, d), 3, (12, 15), 64, 4, 0), digits=4)


@query("q8_residual_energy", f"with {EMB}, g as ({_gauss_sql('t', 'y x', 2.0).format(src='mv')}) select round(sum(power(mv.v-g.v, 2))/sum(mv.v*mv.v), 6) fraction from mv join g on g.y=mv.y and g.x=mv.x and g.t=mv.t")
def _(s, d):
    m = emb(s, d)
    return denoise.residual_energy(m, denoise.gaussian(m, 0, 2.0)).select(r6("fraction").alias("fraction"))


@query("q9_autocorrelation_failures")
def _(s, d):
    m = emb(s, d)
    return stats.autocorrelation_failures(denoise.residual(m, denoise.gaussian(m, 0, 2.0)))


# statistics
LJUNG = """c as (select y, x, t, v - avg(v) over (partition by y, x) z from mv), dn as (select y, x, sum(z*z) e from c group by y, x),
cv as (select a.y, a.x, b.t-a.t k, sum(a.z*b.z) g from c a join c b on a.y=b.y and a.x=b.x and b.t-a.t between 1 and 18 group by 1,2,3)"""


@query("l1_ljung_box", f"with {EMB}, {LJUNG} select y, x, round(64*66*sum(power(g/e, 2)/(64-k)), 4) q from cv join dn using (y, x) group by y, x")
def _(s, d):
    return stats.ljung_box(emb(s, d)).select("y", "x", r6("q", 4).alias("q"))


@query("l4_max_intensity_difference", f"with {EMB}, b as (select y, x, avg(v) m, avg(abs(v)) n from mv where t < 50 group by y, x) select round(avg(n)-avg(m), 6) difference from b")
def _(s, d):
    m = emb(s, d)
    return stats.max_intensity_difference(m, m.withColumn("v", F.abs("v"))).select(r6("difference").alias("difference"))


@query("l5_image_correlation", f"with {EMB}, a as (select y, x, avg(v) a, var_pop(v) b from mv group by y, x) select round(corr(a, b), 6) correlation from a")
def _(s, d):
    m = emb(s, d)
    return stats.image_correlation(projections.mean(m), projections.variance(m)).select(r6("correlation").alias("correlation"))


@query("l6_correlation_to_reference", f"with {EMB}, {MEAN}, c as (select t, corr(mv.v, im.v) c from mv join im using (y, x) group by t) select round(avg(coalesce(c, 0)), 6) correlation from c")
def _(s, d):
    return stats.correlation_to_reference(emb(s, d)).select(r6("correlation").alias("correlation"))


@query("l7_singular_values")
def _(s, d):
    v = stats.singular_values(emb(s, d), 10)
    return s.createDataFrame([(k, round(x, 5)) for k, x in enumerate(v)], "k int, sigma double")


@query("l8_column_correlations", f"with {EMB}, v as (select t i, avg(v) x from mv group by t), m as (select t i, y*25+x j, v m from mv), d as (select j, x-avg(x) over (partition by j) dx, m-avg(m) over (partition by j) dm from m join v using (i)) select cast(j as int) j, round(sum(dx*dm)/(sqrt(sum(dx*dx))*sqrt(sum(dm*dm))), 6) r from d group by j")
def _(s, d):
    m = emb(s, d)
    v = m.groupBy(F.col("t").alias("i")).agg(F.avg("v").alias("x"))
    return stats.column_correlations(v, m.select(F.col("t").alias("i"), (F.col("y") * 25 + F.col("x")).alias("j"), F.col("v").alias("m"))).select("j", r6("r").alias("r"))


def _greedy(image: str, n: int, distance: str, order: str = "desc", name: str = "") -> str:
    """Pixels of ``image`` by value, each at least ``distance`` from all chosen before."""
    return f"""so{name} as (select list({{'y': y, 'x': x, 'v': v}} order by v {order}, y, x) l, {distance} d from {image}),
pk{name} as (select 1 n, [l[1]] c, l, d from so{name} union all select n + 1, list_append(c, list_filter(l, lambda p: len(list_filter(c, lambda q: pow(p.y-q.y, 2) + pow(p.x-q.x, 2) < d*d)) = 0)[1]), l, d from pk{name} where n < {n}),
ch{name} as (select cast(i - 1 as int) rank, c[i].y y, c[i].x x, c[i].v v from pk{name}, range(1, {n + 1}) g(i) where n = {n} and c[i] is not null)"""


def _lcorr(src: str = "mv", tag: str = "") -> str:
    """lc: the local correlation of ``src``; ex: its extent."""
    return LCORR.replace(" mv ", f" {src} ").replace("nb as (select a.y", f"nb{tag} as (select a.y").replace("from nb group", f"from nb{tag} group").replace("lc as", f"lc{tag} as").replace("from lc)", f"from lc{tag})").replace("ex as", f"ex{tag} as")


#: 95 % of the chi-square distribution with 18 degrees of freedom.
LJUNG_LIMIT = 28.869299430392623


def _failures(src: str) -> str:
    return LJUNG.replace("from mv)", f"from {src})", 1) + f", lb as (select y, x, 64*66*sum(power(g/e, 2)/(64-k)) q from cv join dn using (y, x) group by y, x), fa as (select count(*) filter (where q >= {LJUNG_LIMIT}) n from lb)"


LCORR = f"{LOCAL}, lc as (select y, x, coalesce(case when isnan(corr(own, nb)) then 0.0 else corr(own, nb) end, 0.0) v from nb group by y, x), ex as (select greatest(max(y), max(x)) + 1 e from lc)"


@query("l10_separated_pixels", f"with recursive {EMB}, {MEAN}, {_greedy('im', 12, '4.0')} select rank, y, x from ch")
def _(s, d):
    return stats.separated_pixels(mean_image(s, d), 12, 4.0).select("rank", "y", "x")


@query("l12_seed_candidates", f"with recursive {EMB}, {LCORR}, {_greedy('lc', 10, '(select 0.05*e from ex)')} select rank, y, x from ch where v >= 0.3")
def _(s, d):
    return stats.seed_candidates(projections.local_correlation(emb(s, d)), 10).select("rank", "y", "x")


@query("l11_qc_samples", f"""with recursive {EMB}, {LCORR}, {_greedy('lc', 2, '(select 0.2*e from ex)', 'desc', '_h')}, {_greedy('lc', 2, '(select 0.2*e from ex)', 'asc', '_l')},
g as ({_gauss_sql('t', 'y x', 1.0).format(src='mv')}), sp as (select 'high' kind, rank, y, x from ch_h union all select 'low', rank, y, x from ch_l)
select kind, rank, y, x, t, round(mv.v, 6) + 0.0 before, round(g.v, 6) + 0.0 after from sp join mv using (y, x) join g using (y, x, t)""")
def _(s, d):
    m = emb(s, d)
    return stats.qc_samples(m, denoise.gaussian(m, 0, 1.0)).select("kind", "rank", "y", "x", "t", r6("before").alias("before"), r6("after").alias("after"))


@query("d2_ar1", f"with {TRACES}, c as (select id, t, v-avg(v) over (partition by id) z from tr), p as (select id, z, lag(z) over (partition by id order by t) q from c) select id, round(least(greatest(sum(z*q)/sum(z*z), 0.0), 0.998), 6) g from p group by id")
def _(s, d):
    return stats.ar1_coefficients(movie.event_traces(s, d)).select("id", r6("g").alias("g"))


# transients
def traces(s, d):
    return movie.event_traces(s, d).withColumnRenamed("id", "roi")


THR = f"md as (select roi, t, v, quantile_cont(v, 0.5) over (partition by roi) m from tq), th as (select roi, greatest(5*quantile_cont(abs(v-m), 0.5)/{MAD}, quantile_cont(v, 0.95)) thr from md group by roi)"
TQ = "tq as (select id roi, t, v from tr)"
FOUND = f"""{TRACES}, {TQ}, {THR}, fl as (select roi, t, max(cast(v > thr as int)) over (partition by roi order by t rows between 2 preceding and 2 following) f from tq join th using (roi)),
isl as (select roi, t, t-row_number() over (partition by roi order by t) g from fl where f = 1), rn as (select roi, min(t) t0, max(t) t1 from isl group by roi, g having count(*) >= 6),
tn as (select roi, row_number() over (partition by roi order by t0)-1 trans, t0, t1 from rn)"""


@query("d6_thresholds", f"with {TRACES}, {TQ}, {THR} select roi, round(thr, 6) thr from th")
def _(s, d):
    return transients.thresholds(traces(s, d)).select("roi", r6("thr").alias("thr"))


@query("d7_transients", f"with {FOUND} select roi, trans, t0, t1 from tn")
def _(s, d):
    return transients.detect(traces(s, d)).select("roi", F.col("trans").cast("bigint").alias("trans"), "t0", "t1")


@query("d8_padded_transients", f"with {FOUND} select roi, trans, greatest(t0-5, 0) t0, least(t1+5, 719) t1 from tn")
def _(s, d):
    t = traces(s, d)
    return transients.pad(transients.detect(t), t).select("roi", F.col("trans").cast("bigint").alias("trans"), "t0", "t1")


def emb_traces(s, d):
    return masks.region_traces(emb(s, d), movie.embedding_labels(s, d))


EMB_TR = f"{EMB}, {ROI}, tq as (select roi, t, avg(v) v from mv join rp using (y, x) group by roi, t)"
BLOCKS = "fd as (select cast(k as int) roi, cast(j as bigint) trans, cast(10*j+k as int) t0, cast(10*j+k+7 as int) t1 from range(0,5) a(k), range(0,5) b(j))"


def _blocks(s):
    return s.range(25).select((F.col("id") % 5).cast("int").alias("roi"), F.floor(F.col("id") / 5).cast("bigint").alias("trans")).select("roi", "trans", (10 * F.col("trans") + F.col("roi")).cast("int").alias("t0"), (10 * F.col("trans") + F.col("roi") + 7).cast("int").alias("t1"))


SHAPES = f"""with {EMB_TR}, {BLOCKS}, sh as (select fd.roi, trans, mv.y, mv.x, sum(mv.v*tq.v)/sum(tq.v*tq.v) shape, corr(tq.v, mv.v) corr, avg(mv.v) mean from fd join tq on tq.roi=fd.roi and tq.t between t0 and t1 join mv on mv.t=tq.t and mv.y between 3 and 8 and mv.x between fd.roi and fd.roi+6 group by 1,2,3,4)"""


def _shapes(s, d):
    b = s.range(5).select(F.col("id").cast("int").alias("roi"), F.lit(3).alias("y0"), F.lit(8).alias("y1"), F.col("id").cast("int").alias("x0"), (F.col("id") + 6).cast("int").alias("x1"))
    return transients.shapes(emb(s, d), emb_traces(s, d), _blocks(s), b)


@query("d9_shapes", SHAPES + " select roi, trans, y, x, round(shape, 5) + 0.0 shape, round(corr, 5) + 0.0 corr, round(mean, 5) + 0.0 mean from sh")
def _(s, d):
    return _shapes(s, d).select("roi", "trans", "y", "x", *[r6(c, 5).alias(c) for c in ("shape", "corr", "mean")])


PROFILE = "pf as (select roi, y, x, 1.0+y*0.1 w from rp)"
CORRS = SHAPES + f", {PROFILE}, pc as (select sh.roi, trans, corr(coalesce(w, 0), shape) r from sh left join pf on pf.roi=sh.roi and pf.y=sh.y and pf.x=sh.x group by 1,2)"


def _corrs(s, d):
    pf = movie.embedding_labels(s, d).select("roi", "y", "x", (1.0 + F.col("y") * 0.1).alias("w"))
    return transients.profile_correlation(_shapes(s, d), pf)


@query("d11_profile_correlation", CORRS + " select roi, trans, round(r, 5) + 0.0 r from pc")
def _(s, d):
    return _corrs(s, d).select("roi", "trans", r6("r", 5).alias("r"))


@query("d12_classify_by_correlation", CORRS + " select roi, trans, case when r is null or isnan(r) then null when r >= 0.1234567 then 1.0::double else -1.0::double end class from pc")
def _(s, d):
    return transients.classify_by_correlation(_corrs(s, d), 0.1234567).select("roi", "trans", F.col("class").cast("double").alias("class"))


RUNS = f"{EMB_TR}, fl as (select roi, t, t-row_number() over (partition by roi order by t) g from tq where v > 0), fd as (select roi, row_number() over (partition by roi order by min(t))-1 trans, min(t) t0, max(t) t1 from fl group by roi, g)"
OLD = "od as (select roi, t0+(case when trans%2=0 then 0 else 1 end) s, t1+(case when trans%2=0 then 0 else 2 end) e, case when (trans+roi)%3=0 then null when (trans+roi)%3=1 then 1.0::double else -1.0::double end c from fd)"


def _runs(s, d):
    """The runs of each region's trace above zero, as transients."""
    r = transients.runs(emb_traces(s, d).withColumn("flag", F.col("v") > 0), ("roi",))
    return r.select("roi", (F.row_number().over(Window.partitionBy("roi").orderBy("t0")) - 1).cast("bigint").alias("trans"), "t0", "t1")


def _old(s, d):
    odd = F.col("trans") % 2 == 1
    m = (F.col("trans") + F.col("roi")) % 3
    return _runs(s, d).select("roi", (F.col("t0") + F.when(odd, 1).otherwise(0)).alias("t0"), (F.col("t1") + F.when(odd, 2).otherwise(0)).alias("t1"), F.when(m == 1, 1.0).when(m == 2, -1.0).alias("class"))


def _artifacts(s, d):
    return movie.embedding_labels(s, d).select("roi", (F.col("roi") % 4 == 2).alias("artifact")).distinct()


ARTIFACTS = "ar as (select distinct roi, roi % 4 = 2 artifact from rp)"


@query("d10_carry_over", f"with {RUNS}, {OLD}, j as (select fd.roi, trans, max(cast(s=t0 and e=t1 as int)) same, max(case when s=t0 and e=t1 then c end) sc, min(c) a, max(c) b, count(c) n, count(s) k from fd left join od on od.roi=fd.roi and s<=t1 and e>=t0 group by 1,2) select roi, trans, case when same=1 then sc when a=b and n=k then a end class from j")
def _(s, d):
    return transients.carry_over(_runs(s, d), _old(s, d)).select("roi", "trans", "class")


@query("d14_class_cycle", f"with {RUNS}, {OLD} select roi, s, case when c is null then 'false' when c=-1 then 'true' when c=1 then 'mixed' else 'unclassified' end nxt from od")
def _(s, d):
    return _old(s, d).select("roi", F.col("t0").alias("s"), transients.class_name(transients.next_class(F.col("class"))).alias("nxt"))


@query("d15_counts", f"with {RUNS}, {OLD}, {ARTIFACTS}, g as (select * from od join ar using (roi) where not artifact), c as (select count(*) filter (where artifact) a, count(*) filter (where not artifact) b from ar) select count(*) filter (where c=1) n_true, count(*) filter (where c=-1) n_false, count(*) filter (where c is null) n_unclassified, count(*) filter (where c=0) n_mixed, any_value(a) artifact_cells, any_value(b) good_cells from g, (select a, b from c)")
def _(s, d):
    return transients.counts(_old(s, d), _artifacts(s, d))


@query("d17_runs", f"with {EMB}, f as (select y, x, t from mv where v > 0.05), g as (select y, x, t, t-row_number() over (partition by y, x order by t) g from f) select y, x, min(t) t0, max(t) t1, count(*)::bigint n from g group by y, x, g")
def _(s, d):
    return transients.runs(emb(s, d).withColumn("flag", F.col("v") > 0.05), ("y", "x"))


@query("d18_unclassified_cells", f"with {RUNS}, {OLD}, {ARTIFACTS}, o2 as (select roi, case when roi % 2 = 0 then null else c end c from od) select roi from o2 join ar using (roi) where not artifact group by roi having count(c) = 0")
def _(s, d):
    return transients.unclassified_cells(_old(s, d).withColumn("class", F.when(F.col("roi") % 2 == 1, F.col("class"))), _artifacts(s, d))


@query("d19_pixel_lookup", f"with {ROI}, {SMALL}, nr as (select distinct rs.y+a y, rs.x+b x, roi from rs, range(-1,2) p(a), range(-1,2) q(b)) select nr.y::int y, nr.x::int x, string_agg(roi::varchar, ',' order by roi) rois from nr semi join rp g on g.y=nr.y and g.x=nr.x group by 1,2")
def _(s, d):
    got = transients.pixel_lookup(_small(s, d), movie.embedding_labels(s, d))
    return got.select("y", "x", F.array_join(F.col("rois").cast("array<string>"), ",").alias("rois"))


@query("d20_region_at", f"with {ROI} select y, x, min(roi) roi from rp group by y, x")
def _(s, d):
    return transients.region_at(movie.embedding_labels(s, d))


@query("d21_backdrop", f"with {EMB}, {ROI}, {MEAN}, fp as (select roi, y, x, abs(v) w from rp join im using (y, x)), m as (select *, max(w) over (partition by roi) m from fp) select y, x, round(max(w/m), 6) v from m group by y, x")
def _(s, d):
    fp = movie.embedding_labels(s, d).join(mean_image(s, d), ["y", "x"]).select("roi", "y", "x", F.abs("v").alias("w"))
    return image(transients.backdrop(fp))


@query("z7_merge_blocks", """with b as (select user_id roi, h t0, h + (h*13 + user_id) % 9 t1 from (select user_id, cast(floor((epoch_us(ts)/1e6-1704067200)/3600) as int) h from events)),
o as (select *, max(t1) over (partition by roi order by t0, t1 rows between unbounded preceding and 1 preceding) m from b), g as (select *, sum(case when m is null or t0 > m+1 then 1 else 0 end) over (partition by roi order by t0, t1 rows unbounded preceding) g from o) select roi, min(t0) t0, max(t1) t1 from g group by roi, g""")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("roi"), movie.frame_of("ts", 3600).alias("t0"))
    return transients.merge_blocks(e.withColumn("t1", F.col("t0") + (F.col("t0") * 13 + F.col("roi")) % 9))


@query("z14_lookahead_mean", f"with {EMB}, m as (select y, x, t, avg(v) over w m, count(v) over w n from mv window w as (partition by y, x order by t rows between current row and 2 following)) select y, x, t, round(m, 6) + 0.0 v from m where n = 3")
def _(s, d):
    return image(transients.lookahead_mean(emb(s, d)))


@query("z14_trailing_mean", f"with {EMB} select y, x, t, round(avg(v) over (partition by y, x order by t rows between 2 preceding and current row), 6) + 0.0 v from mv")
def _(s, d):
    return image(transients.trailing_mean(emb(s, d)))


@query("x6_merge_groups", f"""with recursive {EMB}, q as (select cast(y//3 as int)*10+cast(x//4 as int) roi, y, x from (select distinct y, x from mv)), rg as (select roi, y, x from q union select roi+1000, y, x from q where (y+x)%2 = 0 union select roi+2000, y, x from q where y%3 = 0),
tq as (select roi, t, avg(v) v from rg join mv using (y, x) group by roi, t), pr as (select distinct a.roi a, b.roi b from rg a join rg b on a.y=b.y and a.x=b.x and a.roi < b.roi),
ed as (select a, b from pr join tq p on p.roi=a join tq q on q.roi=b and q.t=p.t group by a, b having corr(p.v, q.v) >= 0.6), e2 as (select a, b from ed union select b, a from ed), re as (select distinct roi a, roi b from rg union select re.a, e2.b from re join e2 on re.b=e2.a)
select cast(a as int) roi, cast(min(b) as int) "group" from re group by a""")
def _(s, d):
    m = emb(s, d)
    q = m.select(((F.floor(F.col("y") / 3) * 10 + F.floor(F.col("x") / 4)).cast("int")).alias("roi"), "y", "x").distinct()
    rg = q.union(q.filter("(y + x) % 2 = 0").withColumn("roi", F.col("roi") + 1000)).union(q.filter("y % 3 = 0").withColumn("roi", F.col("roi") + 2000))
    return transients.merge_groups(rg, masks.region_traces(m, rg), 0.6)


# patches
def _starts_sql(name: str, n: str, e: int, o: int) -> str:
    """Table ``name`` (k, s): where patches of extent e begin on an axis of n cells; beyond a last regular patch one more where moving it would leave a gap."""
    st = max(1, e - o)
    return f"""{name}_r as (select n, case when n <= {e} then [0::bigint] else range(0, n-{e}+1, {st}) end b, case when n <= {e} then 0 else (n-{e}) % {st} end rest from (select {n} n)),
{name}_b as (select case when rest = 0 then b when rest < {st / 2} and rest <= {o} and len(b) > 1 then list_append(b[1:len(b)-1], (n-{e})::bigint) else list_append(b, (n-{e})::bigint) end b from {name}_r),
{name} as (select generate_subscripts(b, 1)-1 k, unnest(b) s from {name}_b)"""


HEIGHT = "(select max(y)+1 from mv)"
PATCHES = f"{EMB}, {_starts_sql('py', HEIGHT, 8, 2)}, {_starts_sql('px', '25', 10, 3)}"


def _height(m: DataFrame) -> int:
    return m.agg(F.max("y") + 1).first()[0]


@query("x4_patch_starts", f"with {PATCHES} select 'y' axis, k::int k, s::int start, (select count(*) from mv where y >= s and y < s+8) n from py union all select 'x', k::int, s::int, (select count(*) from mv where x >= s and x < s+10) from px")
def _(s, d):
    m, out = emb(s, d), []
    for axis, begin, extent in (("y", patches.starts(_height(m), 8, 2), 8), ("x", patches.starts(25, 10, 3), 10)):
        got = patches.assign(m, {axis: (begin, extent)}).groupBy("patch").agg(F.count(F.lit(1)).alias("n"))
        out.append(got.select(F.lit(axis).alias("axis"), F.col("patch").alias("k"), patches.start_of(F.col("patch"), begin).alias("start"), "n"))
    return out[0].unionByName(out[1])


@query("x5_patches", f"with {PATCHES}, c as (select (py.k*(select count(*) from px)+px.k)::int patch, py.s::int y0, least(py.s+8, {HEIGHT})::int y1, px.s::int x0, (px.s+10)::int x1 from py, px) select patch, y0, y1, x0, x1, count(*) n, round(sum(v), 5) + 0.0 total from c join mv on y >= y0 and y < y1 and x >= x0 and x < x1 group by all")
def _(s, d):
    m = emb(s, d)
    h = _height(m)
    held = patches.assign(m, {"y": (patches.starts(h, 8, 2), 8), "x": (patches.starts(25, 10, 3), 10)})
    sums = held.groupBy("patch").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("v"), 5).alias("total"))
    return patches.patch_table(s, (h, 25), (8, 10), (2, 3)).join(sums, "patch")


@query("z10_tiles", f"""with {EMB}, {MEAN}, h as (select max(y)+1 h from im), c as (select r//8*4 + q//8 tile, r y0, least(r+8, h)-1 y1, q x0, least(q+8, 25)-1 x1, h from h, unnest(range(0, h, 8)) g(r), range(0, 25, 8) z(q)),
e as (select tile::int tile, y0::int y0, y1::int y1, x0::int x0, x1::int x1, greatest(y0-3, 0)::int hy0, least(y1+3, h-1)::int hy1, greatest(x0-3, 0)::int hx0, least(x1+3, 24)::int hx1 from c)
select e.*, round(sum(v) filter (where y between y0 and y1 and x between x0 and x1), 6) + 0.0 own, round(sum(v), 6) + 0.0 total from e join im on y between hy0 and hy1 and x between hx0 and hx1 group by all""")
def _(s, d):
    im = mean_image(s, d)
    every = s.createDataFrame([(t["tile"], *t["core"], *t["read"]) for t in patches.tiles(_height(im), 25, 8, 3)], "tile int, y0 int, y1 int, x0 int, x1 int, hy0 int, hy1 int, hx0 int, hx1 int")
    cells = every.select("*", F.explode(F.sequence("hy0", "hy1")).alias("y")).select("*", F.explode(F.sequence("hx0", "hx1")).alias("x"))
    own = F.col("y").between(F.col("y0"), F.col("y1")) & F.col("x").between(F.col("x0"), F.col("x1"))
    return cells.join(im, ["y", "x"]).groupBy(*every.columns).agg(r6(F.sum(F.when(own, F.col("v"))), 6).alias("own"), r6(F.sum("v"), 6).alias("total"))


@query("s10_interleaved_slices", f"with {VOL}, f as (select l*10+w s, d, t, v from vo), n as (select max(s)+1 n from f) select cast(s//10 as int) t2, cast(s%10 as int) depth, d, t, round(v, 6) + 0.0 v from f")
def _(s, d):
    from lumiframe.sources.folders import deinterleave

    f = movie.embedding_volume(s, d).select((F.col("l") * 10 + F.col("w")).alias("s"), "d", "t", "v")
    return deinterleave(f, 10, "s", "t2", "depth", whole=False).select("t2", "depth", "d", "t", r6().alias("v"))


@query("s11_preview", f"with {EMB} select y, x, t, round(v, 6) + 0.0 v from mv where t < 10")
def _(s, d):
    from lumiframe.sources.folders import preview

    return image(preview(emb(s, d), 10))


@query("s12_preview_volume", f"with {VOL} select l, w, d, t, round(v, 6) + 0.0 v from vo where t < 4")
def _(s, d):
    from lumiframe.sources.folders import preview

    return image(preview(movie.embedding_volume(s, d), 5000, 2000, 500), VK)


# volumes
@query("v1_downsample", f"with {VOL}, f as (select l, w, d, max(v) v from vo group by l, w, d), n as (select max(l)+1 nl from f) select cast(l as int) l, cast(w//2 as int) w, cast(d//2 as int) d, round(avg(v), 6) v from f group by 1,2,3")
def _(s, d):
    v = movie.embedding_volume(s, d).groupBy("l", "w", "d").agg(F.max("v").alias("v"))
    planes = v.agg(F.max("l") + 1).first()[0]
    return image(render.downsample(v, shape=(planes, 10, 10), factors=(1, 2, 2)), VK)


@query("v2_normalise", f"with {VOL}, f as (select l, w, d, max(v) v from vo group by l, w, d), p as (select greatest(quantile_cont(v, 0.995), 1e-6) p from f) select l, w, d, round(least(greatest(v/p, 0.0), 1.0), 6) + 0.0 v from f, p")
def _(s, d):
    return image(render.normalise(movie.embedding_volume(s, d).groupBy("l", "w", "d").agg(F.max("v").alias("v"))), VK)


@query("v3_mip", f"with {VOL}, f as (select w, d, max(v) v from vo group by w, d) select w, d, round(v/(select greatest(max(v), 1e-6) from f), 6) v from f")
def _(s, d):
    return image(render.project(movie.embedding_volume(s, d).groupBy("l", "w", "d").agg(F.max("v").alias("v"))), ("w", "d"))


@query("v3_composite", f"""with {VOL}, g as (select l, w, d, max(v) v from vo group by l, w, d), f as (select l, w, d, v, least(power(v, 1.6)*3.0, 1.0) a from g),
th as (select *, exp(coalesce(sum(case when a < 1 then ln(1-a) else -1e6 end) over (partition by w, d order by l rows between unbounded preceding and 1 preceding), 0)) q from f), im as (select w, d, sum(v*a*q) v from th group by w, d)
select w, d, round(v/(select greatest(max(v), 1e-6) from im), 6) v from im""")
def _(s, d):
    return image(render.project(movie.embedding_volume(s, d).groupBy("l", "w", "d").agg(F.max("v").alias("v")), "composite"), ("w", "d"))


def _channel(n: int) -> str:
    return f"round(1 - greatest(0.0, least(({n}+roi*0.6)%6, 4-(({n}+roi*0.6)%6), 1.0)), 6) + 0.0"


@query("v4_overlay", f"with {ROI} select y, x, {_channel(5)} r, {_channel(3)} g, {_channel(1)} b, case roi%3 when 0 then 1.0 when 1 then 0.5 else 0.08 end a from rp where roi < 10")
def _(s, d):
    st = s.createDataFrame([(k, k, ("accepted", "candidate", "rejected")[k % 3]) for k in range(10)], "roi int, pos int, status string")
    return render.overlay(movie.embedding_labels(s, d), st).select("y", "x", *[r6(c).alias(c) for c in "rgba"])


ORACLES["q9_autocorrelation_failures"] = f"with {EMB}, g as ({_gauss_sql('t', 'y x', 2.0).format(src='mv')}), rs as (select mv.y, mv.x, mv.t, mv.v-g.v v from mv join g on g.y=mv.y and g.x=mv.x and g.t=mv.t), {_failures('rs')} select n failures from fa"


def flagship(s: SparkSession, d: str) -> DataFrame:
    return image(projections.local_correlation(emb(s, d))).orderBy(F.desc("v"), "y", "x").limit(10)
