"""Queries whose results SQL can't give: registration, region growing, factorisation, contamination fits, online detection, file formats.

They run on movies made of the driver's tables; the tests hold the operators against numpy.

The scene: the embedding movie as noise, with a round cell in each block of 10 rows and 12 columns. What the vector at its centre
has above 0.15 makes the cell active, and the activity decays over the next frames. Its cells, and so the work, grow with the table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumiframe.functions import kernels
from lumiframe.functions.columns import correlation
from lumiframe.operators import contamination, factor, masks, movie, projections, register, rois, template, transients
from lumiframe.plans.imaging import EMB, MEAN, ROI, emb, emb_traces, image, r6
from lumiframe.plans import imaging
from lumiframe.streaming import online

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def cells_movie(h: int = 30, w: int = 30, t: int = 120, seed: int = 0, centres=((8, 8), (21, 20)), noise: float = 0.05) -> np.ndarray:
    """Gaussian cells with decaying activity on a flat, noisy field."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    out = noise * rng.normal(size=(h, w, t)) + 1
    for c in centres:
        spikes = (rng.random(t) < 0.06) * rng.uniform(1, 2, t)
        trace = np.zeros(t)
        for k in range(t):
            trace[k] = spikes[k] + (0.9 * trace[k - 1] if k else 0)
        out += np.exp(-((y - c[0]) ** 2 + (x - c[1]) ** 2) / 8)[..., None] * 3 * trace
    return out


LASTS = 12
SCENE = f"""{EMB}, ac as (select y, x, cast(t+k as int) t, sum(greatest(v-0.15, 0)*pow(0.8, k)) a from mv, range(0, {LASTS}) g(k) where y%10=5 and x%12=6 and t+k < 64 group by 1, 2, 3),
sc as (select mv.y, mv.x, mv.t, 1 + 0.1*mv.v + coalesce(20*c.a*exp(-(pow(mv.y-c.y, 2)+pow(mv.x-c.x, 2))/8), 0) v from mv left join ac c on c.t=mv.t and c.y=mv.y//10*10+5 and c.x=mv.x//12*12+6)"""
CENTRES = "ce as (select distinct cast(y//10*2+x//12 as int) seed, y sy, x sx from mv where y%10=5 and x%12=6)"


def activity(m: DataFrame, keys=("y", "x")) -> DataFrame:
    """(keys..., t, a): what lies above 0.15, decaying."""
    w, a = Window.partitionBy(*keys).orderBy("t"), F.greatest(F.col("v") - 0.15, F.lit(0.0))
    return m.withColumn("a", a).withColumn("a", sum((F.coalesce(F.lag("a", k).over(w), F.lit(0.0)) * 0.8**k for k in range(1, LASTS)), F.col("a"))).drop("v")


def scene(s: SparkSession, d: str) -> DataFrame:
    m, block = emb(s, d), lambda k, n: F.floor(F.col(k) / n).cast("int").alias(f"__{k}")
    cells = activity(m.filter("y % 10 = 5 and x % 12 = 6")).select(block("y", 10), block("x", 12), "t", "a", F.col("y").alias("cy"), F.col("x").alias("cx"))
    near = F.exp(-(F.pow(F.col("y") - F.col("cy"), 2) + F.pow(F.col("x") - F.col("cx"), 2)) / 8)
    held = m.select("*", block("y", 10), block("x", 12)).join(cells, ["__y", "__x", "t"], "left")
    return held.select("y", "x", "t", (1 + 0.1 * F.col("v") + F.coalesce(20 * F.col("a") * near, F.lit(0.0))).alias("v"))


def centres(s: SparkSession, d: str) -> DataFrame:
    """(seed, sy, sx) of the scene's cells."""
    p = movie.embedding_labels(s, d).filter("y % 10 = 5 and x % 12 = 6")
    return p.select((F.floor(F.col("y") / 10) * 2 + F.floor(F.col("x") / 12)).cast("int").alias("seed"), F.col("y").alias("sy"), F.col("x").alias("sx"))


def shape_of(m: DataFrame) -> tuple[int, int]:
    return m.agg(F.max("y") + 1).first()[0], 25


def volume_scene(s: SparkSession, d: str) -> DataFrame:
    """The same as a volume: a cell for four planes, about its third."""
    v = movie.embedding_volume(s, d)
    cells = activity(v.filter("l % 4 = 2 and w = 5 and d = 5"), movie.VOLUME).select(F.floor(F.col("l") / 4).alias("__l"), "t", "a", F.col("l").alias("cl"))
    near = F.exp(-(F.pow(F.col("l") - F.col("cl"), 2) + F.pow(F.col("w") - 5, 2) + F.pow(F.col("d") - 5, 2)) / 4)
    held = v.withColumn("__l", F.floor(F.col("l") / 4)).join(cells, ["__l", "t"], "left")
    return held.select("l", "w", "d", "t", (1 + 0.1 * F.col("v") + F.coalesce(20 * F.col("a") * near, F.lit(0.0))).alias("v"))


# registration
@query("r4_bootstrap_template", f"with {EMB} select y, x, round(quantile_cont(v, 0.5), 6) + 0.0 v from mv where t < 20 group by y, x")
def _(s, d):
    return image(register.bootstrap_template(emb(s, d), 20))


@query("r3_integer_shift", f"with {EMB}, h as (select max(y) hy from mv), k as (select mv.y, mv.x, mv.t, least(greatest(mv.y-(mv.t%3-1), 0), hy) sy, least(greatest(mv.x-(mv.t%2), 0), 24) sx from mv, h) select k.y, k.x, k.t, round(b.v, 6) + 0.0 v from k join mv b on b.y=k.sy and b.x=k.sx and b.t=k.t")
def _(s, d):
    m = emb(s, d)
    sh = s.range(64).select(F.col("id").cast("int").alias("t"), (F.col("id") % 3 - 1).cast("int").alias("dy"), (F.col("id") % 2).cast("int").alias("dx"))
    h = m.agg(F.max("y") + 1).first()[0]
    return image(register.integer_shift(m, sh, (h, 25)))


@query("r7_low_signal_patches", f"with {EMB}, {MEAN}, a as (select stddev_pop(v) s from im) select cast(y//5 as int) py, cast(x//5 as int) px, stddev_pop(v) < 0.9*(select s from a) low from im group by 1, 2")
def _(s, d):
    return register.low_signal_patches(projections.mean(emb(s, d)), 5, 0.9)


# every fourth frame is moved, so the medians that make templates aren't
MOVES = "mo as (select distinct t, case when t%4=3 then t//4%3-1 else 0 end dy, case when t%4=3 then t//12%3-1 else 0 end dx from mv)"


def _moves(m: DataFrame) -> DataFrame:
    t = F.col("t")
    move = lambda n: F.when(t % 4 == 3, F.floor(t / n) % 3 - 1).otherwise(0).cast("int")
    return m.select("t").distinct().select("t", move(4).alias("dy"), move(12).alias("dx"))


def _drifting(s: SparkSession, d: str) -> DataFrame:
    """The scene's mean image with the embedding movie's noise, moved by whole pixels; written once, as registration reads it for each of its steps."""
    m, still = emb(s, d), projections.mean(scene(s, d)).withColumnRenamed("v", "still")
    noisy = m.join(still, ["y", "x"]).select("y", "x", "t", (10 * F.col("still") + 0.1 * F.col("v")).alias("v"))
    return template.written(register.integer_shift(noisy, _moves(m), shape_of(m)), "drifting")


for method, options in (("rigid", {}), ("patch", {"grid": 15}), ("patchwarp", {"parts": 2, "iterations": 10})):
    QUERIES[f"r11_correct_{method}"] = lambda s, d, m=method, o=options: image(register.correct(_drifting(s, d), m, upsample=10, bin_frames=32, first=16, **o)[0], digits=3)


@query("r6_rigid_shifts", f"with {EMB}, {MOVES} select t, cast(-dy as double) + 0.0 dy, cast(-dx as double) + 0.0 dx from mo")
def _(s, d):
    sh = register.rigid(_drifting(s, d), upsample=1, bin_frames=32, first=16)[1]
    return sh.select("t", r6(F.col("shift")[0], 2).alias("dy"), r6(F.col("shift")[1], 2).alias("dx"))


@query("r16_assess")
def _(s, d):
    m = _drifting(s, d)
    out, _, end, start = register.rigid(m, upsample=10, bin_frames=32, first=16)
    return register.assess(m, out, start, end).select(*[F.round(c, 4).alias(c) for c in ("before", "after", "difference", "templates")])


# region growing
@query("c1_seed_trace", f"with {EMB} select t, round(avg(v), 6) + 0.0 v from mv where y between 9 and 11 and x between 11 and 13 group by t")
def _(s, d):
    return rois.seed_trace(emb(s, d), 10, 12, 1).select("t", r6().alias("v"))


@query("c2_seed_correlations", f"with {EMB}, s as (select t, v s from mv where y=10 and x=12) select y, x, round(coalesce(case when isnan(corr(v, s)) then 0.0 else corr(v, s) end, 0.0), 6) + 0.0 v from mv join s using (t) where power(y-10, 2)+power(x-12, 2) <= 25 group by y, x")
def _(s, d):
    return image(rois.seed_correlations(emb(s, d), 10, 12, 5))


@query("c5_objectives", f"with {EMB}, {ROI}, tq as (select roi, t, avg(v) v from mv join rp using (y, x) group by roi, t), f as (select t, avg(v) n from mv group by t) select roi, round(-corr(v, n), 6) decorrelation, round(sum(v-n)/var_samp(n), 3) difference from tq join f using (t) group by roi")
def _(s, d):
    f = emb(s, d).groupBy("t").agg(F.avg("v").alias("n"))
    return emb_traces(s, d).join(f, "t").groupBy("roi").agg(r6(-correlation("v", "n")).alias("decorrelation"), r6(F.sum(F.col("v") - F.col("n")) / F.var_samp("n"), 3).alias("difference"))


for growth in rois.GROWTH:
    @query(f"c7_from_seeds_{growth}")
    def _(s, d, growth=growth):
        return rois.from_seeds(scene(s, d), centres(s, d), 0.9, 6, growth=growth).select("seed", "y", "x", r6("threshold").alias("threshold"))


# about a cell's centre what correlates is one piece without holes, so cleaning it leaves it as it is
ORACLES["c7_from_seeds_local_corr_threshold"] = f"with {SCENE}, {CENTRES} select seed, p.y, p.x, any_value(0.9::double) threshold from ce join sc q on q.y=sy and q.x=sx join sc p on p.t=q.t and pow(p.y-sy, 2)+pow(p.x-sx, 2) <= 36 group by seed, p.y, p.x having corr(p.v, q.v) > 0.9"


@query("c6_best_threshold")
def _(s, d):
    return rois.from_seeds(scene(s, d), centres(s, d), None, 6).select("seed", "y", "x", r6("threshold").alias("threshold"))


# deconvolution and factorisation
@query("d3_deconvolve")
def _(s, d):
    return factor.deconvolve(movie.event_traces(s, d), "id").select("id", "t", r6("calcium", 3).alias("calcium"), r6("spike", 3).alias("spike"))


@query("f6_project_traces", f"with {EMB}, {ROI} select roi, t, round(sum((1.0+x*0.1)*v), 5) + 0.0 v from mv join rp using (y, x) group by roi, t")
def _(s, d):
    fp = movie.embedding_labels(s, d).select("roi", "y", "x", (1.0 + F.col("x") * 0.1).alias("w"))
    return factor.project_traces(emb(s, d), fp).select("roi", "t", r6("v", 5).alias("v"))


RINGS = "(values {}) o(dy, dx)".format(", ".join(f"({a},{b})" for a, b in factor.ring_offsets(1.5, 3)))


@query("f11_ring_offsets", f"with {EMB}, {MEAN} select a.y, a.x, count(*) n, round(avg(b.v), 6) + 0.0 mean from im a cross join {RINGS} join im b on b.y=a.y+dy and b.x=a.x+dx group by a.y, a.x")
def _(s, d):
    im = projections.mean(emb(s, d))
    ring = F.array(*[F.struct(F.lit(a).alias("y"), F.lit(b).alias("x")) for a, b in factor.ring_offsets(1.5, 3)])
    at = im.select("y", "x", F.explode(ring).alias("o")).select(F.col("y").alias("ay"), F.col("x").alias("ax"), (F.col("y") + F.col("o.y")).alias("y"), (F.col("x") + F.col("o.x")).alias("x"))
    return at.join(im, ["y", "x"]).groupBy(F.col("ay").alias("y"), F.col("ax").alias("x")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("v")).alias("mean"))


@query("f13_ring_predict", f"with {EMB} select a.y, a.x, b.t, round(sum((1.0+dy*0.1-dx*0.05)*b.v), 5) + 0.0 v from (select distinct y, x from mv) a cross join {RINGS} join mv b on b.y=a.y+dy and b.x=a.x+dx group by a.y, a.x, b.t")
def _(s, d):
    m = emb(s, d)
    offs = s.createDataFrame(factor.ring_offsets(1.5, 3), "dy int, dx int")
    w = m.select("y", "x").distinct().crossJoin(F.broadcast(offs)).withColumn("w", 1.0 + F.col("dy") * 0.1 - F.col("dx") * 0.05)
    return image(factor.ring_predict(m, w), digits=5)


@query("f14_block_mean", f"with {EMB} select cast(y//4 as int) y, cast(x//4 as int) x, t, round(sum(v)/16, 6) + 0.0 v from mv group by 1, 2, 3")
def _(s, d):
    return image(factor.block_mean(emb(s, d), 4))


def _extract(s: SparkSession, d: str, method: str, **options) -> DataFrame:
    m = scene(s, d)
    fp, _ = factor.extract_patches(m, shape_of(m), (20, 25), 5, method=method, n=6, **options)
    return fp.select("roi", "y", "x", r6("w", 4).alias("w"))


QUERIES["f9_extract"] = lambda s, d: _extract(s, d, "two_photon")
QUERIES["f16_extract_one_photon"] = lambda s, d: _extract(s, d, "one_photon", least_corr=0.5, least_peak=3)


@query("f10_extract_patches")
def _(s, d):
    m = scene(s, d)
    fp, tr = factor.extract_patches(m, shape_of(m), (12, 14), 4, n=2)
    return tr.groupBy("roi").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("v"), 3).alias("peak"))


@query("f19_extract_ica")
def _(s, d):
    m = scene(s, d)
    return factor.extract_ica(m, shape_of(m), (20, 25), 5, n_components=6, n_ica=4).select("roi", "y", "x")


# contamination
def _cells(s: SparkSession, d: str):
    """The scene, its pixels, regions of five by five pixels about the cells' centres, and the height."""
    m, grid = scene(s, d), movie.embedding_labels(s, d).select("y", "x")
    five = F.array(*[F.lit(k) for k in range(-2, 3)])
    reg = centres(s, d).select(F.col("seed").alias("roi"), "sy", "sx", F.explode(five).alias("a")).select("roi", (F.col("sy") + F.col("a")).alias("y"), "sx", F.explode(five).alias("b")).select("roi", "y", (F.col("sx") + F.col("b")).alias("x"))
    return m, grid, reg.join(grid, ["y", "x"], "left_semi").select("roi", "y", "x"), shape_of(m)[0]


@query("d16_profiles", f"""with {ROI}, rs as (select * from rp where roi = 1 and y between 4 and 9), k(o, w) as (values {', '.join(f'({i - 6}, {w!r}::double)' for i, w in enumerate(kernels.gaussian_taps(1.5)))})
select roi, rs.y+a.o y, rs.x+b.o x, round(sum(a.w*b.w), 6) w from rs cross join k a cross join k b semi join rp g on g.y=rs.y+a.o and g.x=rs.x+b.o group by 1, 2, 3""")
def _(s, d):
    rp = movie.embedding_labels(s, d)
    return contamination.profiles_of(rp.filter("roi = 1 and y between 4 and 9"), rp.select("y", "x")).select("roi", "y", "x", r6("w").alias("w"))


@query("z4_cell_windows", f"with {ROI}, rs as (select * from rp where roi = 1 and y between 4 and 9), h as (select max(y) hy from rp) select roi, greatest(min(y)-3, 0) y0, least(max(y)+3, max(hy)) y1, greatest(min(x)-3, 0) x0, least(max(x)+3, 24) x1 from rs, h group by roi")
def _(s, d):
    rp = movie.embedding_labels(s, d)
    h = rp.agg(F.max("y") + 1).first()[0]
    return contamination.cell_windows(rp.filter("roi = 1 and y between 4 and 9").withColumn("w", F.lit(1.0)), h, 25, 3)


@query("z1_spot", f"""with {EMB}, {MEAN}, g as (select y dy, x dx, exp(-(pow(x-3, 2) + pow(y-3, 2)) / (2*1.2*1.2)) e from range(0, 7) a(y), range(0, 7) b(x)), k as (select dy, dx, e / sqrt(sum(e*e) over ()) w from g where e >= 0.01)
select a.y, a.x, round(sum(w*b.v), 6) + 0.0 v from im a cross join k join im b on b.y=a.y+dy-3 and b.x=a.x+dx-3 group by a.y, a.x""")
def _(s, d):
    from lumiframe.functions.solvers import gaussian_blob

    im, g = projections.mean(emb(s, d)), gaussian_blob(1.2)
    half = g.shape[0] // 2
    spot = F.array(*[F.struct(F.lit(int(a) - half).alias("dy"), F.lit(int(b) - half).alias("dx"), F.lit(float(g[a, b])).alias("w")) for a, b in np.ndindex(g.shape) if g[a, b] > 0])
    weights = im.select("y", "x", F.explode(spot).alias("o")).select("y", "x", "o.dy", "o.dx", "o.w")
    return image(factor.ring_predict(im.withColumn("t", F.lit(0)), weights).drop("t"))


@query("z6_time_courses")
def _(s, d):
    m, grid, reg, h = _cells(s, d)
    pf = contamination.profiles_of(reg, grid)
    return contamination.time_courses(m, pf, h, 25, zero=1.0, pad=4).select("roi", "t", r6("tc", 3).alias("tc"), r6("tc_lsq", 3).alias("tc_lsq"))


@query("z8_time_courses_of_transients")
def _(s, d):
    m, grid, reg, h = _cells(s, d)
    pf = contamination.profiles_of(reg, grid)
    found = transients.detect(masks.region_traces(m, reg), 1, 3)
    return contamination.time_courses(m, pf, h, 25, zero=1.0, pad=4, average=2, blocks=contamination.blocks_of(found)).select("roi", "t", r6("tc", 3).alias("tc"))


for criterion in contamination.CRITERIA:
    @query(f"d12_classify_{criterion}")
    def _(s, d, criterion=criterion):
        m, grid, reg, h = _cells(s, d)
        pf = contamination.profiles_of(reg, grid)
        tr = masks.region_traces(m, reg)
        found = transients.detect(tr, 1, 3)
        b = contamination.cell_windows(pf.filter("w > 0.05"), h, 25, 1)
        return contamination.classify(transients.shapes(m, tr, found, b), pf, criterion).select("roi", "trans", "class", r6("corr", 3).alias("corr"), r6("ratio", 3).alias("ratio"))


# online detection
def _pairs(s, d):
    q = emb(s, d).select((F.floor(F.col("y") / 3) * 10 + F.floor(F.col("x") / 4)).cast("int").alias("roi"), "y", "x").distinct()
    return q.union(q.filter("(y + x) % 2 = 0").withColumn("roi", F.col("roi") + 1000)).union(q.filter("y % 3 = 0").withColumn("roi", F.col("roi") + 2000))


PAIRS = f"{EMB}, q as (select distinct cast(y//3 as int)*10+cast(x//4 as int) roi, y, x from mv), rg as (select roi, y, x from q union all select roi+1000, y, x from q where (y+x)%2 = 0 union all select roi+2000, y, x from q where y%3 = 0)"


@query("z19_merge_candidates", f"with {PAIRS}, sz as (select roi, count(*) n, 2*(max(y)-min(y)+1+max(x)-min(x)+1) e from rg group by roi), j as (select a.roi a, b.roi b, count(*) common from rg a join rg b on a.y=b.y and a.x=b.x and a.roi < b.roi group by 1, 2) select a, b, common from j join sz p on p.roi=a join sz q on q.roi=b where p.n-common <= p.e/2 or q.n-common <= q.e/2 or common >= 0.75*least(p.n, q.n)")
def _(s, d):
    return online.merge_candidates(_pairs(s, d))


@query("z22_containment_ratios", f"with {PAIRS}, pf as (select roi, y, x, 1.0+x*0.1 w from rg), own as (select roi, sum(w*w) e from pf group by roi), j as (select a.roi a, b.roi b, sum(a.w*b.w) ab, sum(a.w*a.w) aa, sum(b.w*b.w) bb from pf a join pf b on a.y=b.y and a.x=b.x and a.roi < b.roi group by 1, 2) select a, b, round((ab/p.e) / (ab/aa), 6) rho_a, round((ab/q.e) / (ab/bb), 6) rho_b from j join own p on p.roi=a join own q on q.roi=b")
def _(s, d):
    pf = _pairs(s, d).withColumn("w", 1.0 + F.col("x") * 0.1)
    return online.containment_ratios(pf).select("a", "b", r6("rho_a").alias("rho_a"), r6("rho_b").alias("rho_b"))


@query("z23_split_profiles", f"""with {PAIRS}, pf as (select roi, y, x, 1.0+x*0.1 w from rg), own as (select roi, sum(w*w) e from pf group by roi),
    j as (select a.roi a, b.roi b, sum(a.w*a.w) aa, sum(b.w*b.w) bb from pf a join pf b on a.y=b.y and a.x=b.x and a.roi < b.roi group by 1, 2),
    r as (select a, b, aa/p.e ra, bb/q.e rb from j join own p on p.roi=a join own q on q.roi=b),
    s as (select case when ra > rb then a else b end i, case when ra > rb then b else a end o from r where greatest(ra, rb) >= 0.75 and least(ra, rb) < 0.75 and least(ra, rb) <= 0.75*greatest(ra, rb)),
    k as (select s.i, s.o, sum(pi.w*po.w)/sum(pi.w*pi.w) scale from s join pf pi on pi.roi=s.i join pf po on po.roi=s.o and po.y=pi.y and po.x=pi.x group by 1, 2),
    rest as (select k.i, k.o, scale, po.y, po.x, greatest(po.w - scale*coalesce(pi.w, 0), 0) w from k join pf po on po.roi=k.o left join pf pi on pi.roi=k.i and pi.y=po.y and pi.x=po.x where scale > 0 and scale < 2)
    select i "inner", o "outer", round(scale, 6) scale, y, x, round(w, 6) w from (select *, max(w) over (partition by i, o) peak from rest) where w > 0.01*peak""")
def _(s, d):
    pf = _pairs(s, d).withColumn("w", 1.0 + F.col("x") * 0.1)
    return online.split_profiles(pf).select("inner", "outer", r6("scale").alias("scale"), "y", "x", r6("w").alias("w"))


@query("f22_extract_online")
def _(s, d):
    det = online.Detection(cutoff=3.0, least_pixels=6)
    m = scene(s, d)
    return online.extract_online(m, shape_of(m), detection=det, promotion=online.Promotion(after=3)).select("roi", "y", "x", r6("w", 3).alias("w"))


@query("s19_match_regions", f"with {ROI} select roi, case when roi % 2 = 0 then 'm' || roi end source_method, count(*) n from rp group by roi")
def _(s, d):
    from lumiframe.pipeline import match_regions

    base = movie.embedding_labels(s, d).groupBy("roi").agg(F.count(F.lit(1)).alias("n"))
    saved = base.filter("roi % 2 = 0").select("roi", F.concat(F.lit("m"), F.col("roi").cast("string")).alias("source_method"))
    return match_regions(base, saved).select("roi", "source_method", "n")


def _session(s, d):
    """A session over the embedding movie with its labels as regions, every third rejected, and their transients."""
    from lumiframe.pipeline import Session

    m, px = emb(s, d), movie.embedding_labels(s, d)
    status = F.when(F.col("roi") % 3 == 0, "rejected").otherwise("accepted")
    regions = px.select("roi").distinct().select("roi", F.lit("labels").alias("source_method"), status.alias("status"), F.lit("{}").alias("params"))
    return Session(s).load(m, d).commit_regions(regions, px, "Labels", {"width": 25})


@query("s17_session_output", f"""with {imaging.RUNS}, pn as (select roi, count(*) pixels from rp group by roi), tn as (select roi, count(*) n, count(*) filter (where trans % 2 = 0) n_true, sum(t1-t0+1)::bigint frames from fd group by roi)
select roi, roi % 4 = 2 artifact, pixels, coalesce(n, 0) transients, coalesce(n_true, 0) n_true, coalesce(frames, 0)::bigint frames, 'load,source_extraction' stages from pn left join tn using (roi) where roi % 3 <> 0""")
def _(s, d):
    import uuid

    from lumiframe.operators.graph import shared_folder
    from lumiframe.pipeline import Session

    found = imaging._runs(s, d).withColumn("class", F.when(F.col("trans") % 2 == 0, 1.0))
    where = f"{shared_folder(s)}/session-{uuid.uuid4().hex}"
    _session(s, d).commit_validation(found, imaging._artifacts(s, d)).save(where)
    back = Session.restore(s, where)
    own = back.pixels.groupBy("roi").agg(F.count(F.lit(1)).alias("pixels"))
    times = back.transients.groupBy("roi").agg(F.count(F.lit(1)).alias("transients"), F.count(F.when(F.col("class") == 1, 1)).alias("n_true"), F.sum(F.col("t1") - F.col("t0") + 1).alias("frames"))
    joined = back.regions.join(back.artifacts, "roi").join(own, "roi").join(times, "roi", "left").na.fill(0, ["transients", "n_true", "frames"])
    return joined.select("roi", "artifact", "pixels", "transients", "n_true", "frames", F.lit(",".join(x.stage for x in back.steps)).alias("stages"))


# dictionaries
@query("f20_dictionary")
def _(s, d):
    from lumiframe.operators import dictionary

    m = scene(s, d)
    fp, _ = dictionary.extract(m, shape_of(m), (20, 25), n=4)
    return fp.select("roi", "y", "x", r6("weight", 3).alias("weight"))


@query("f21_dictionary_volume")
def _(s, d):
    from lumiframe.operators import dictionary

    v = volume_scene(s, d)
    mask = v.select("l", "w", "d").distinct().filter("w between 2 and 8 and d between 2 and 8")
    fp, _ = dictionary.extract(v, (v.agg(F.max("l") + 1).first()[0], 10, 10), (12, 10, 10), (2, 2, 2), 4, mask=mask, keys=movie.VOLUME)
    return fp.groupBy("roi").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l"), 2).alias("l"), F.round(F.avg("w"), 2).alias("w"))


@query("r12_rigid_volume", f"with {EMB}, {MOVES} select t, 0.0::double d0, cast(-dy as double) + 0.0 d1, cast(-dx as double) + 0.0 d2 from mo")
def _(s, d):
    v = volume_scene(s, d)
    still = v.groupBy("l", "w", "d").agg((10 * F.avg("v")).alias("v"))
    edge = lambda k, by: F.least(F.greatest(F.col(k) - F.col(by), F.lit(0)), F.lit(9)).alias(k)
    moved = v.join(_moves(v), "t").select("l", F.col("w").alias("ow"), F.col("d").alias("od"), "t", edge("w", "dy"), edge("d", "dx")).join(still, ["l", "w", "d"])
    moved = template.written(moved.select("l", F.col("ow").alias("w"), F.col("od").alias("d"), "t", "v"), "drifting")
    sh = register.rigid(moved, most=3, upsample=1, bin_frames=32, first=16, keys=movie.VOLUME)[1]
    return sh.select("t", *[r6(F.col("shift")[k], 2).alias(f"d{k}") for k in range(3)])


@query("x12_overlapping_boxes", f"""with {PAIRS}, b as (select roi, min(y) ly, max(y) hy, min(x) lx, max(x) hx from rg group by roi)
select p.roi a, q.roi b, p.ly<=q.ly and q.hy<=p.hy and p.lx<=q.lx and q.hx<=p.hx contains, least(p.ly, q.ly) lo_y, greatest(p.hx, q.hx) hi_x from b p join b q on p.roi < q.roi and p.ly<=q.hy and q.ly<=p.hy and p.lx<=q.hx and q.lx<=p.hx""")
def _(s, d):
    b = _pairs(s, d).groupBy("roi").agg(*[f(k).alias(f"{n}_{k}") for k in "yx" for n, f in (("lo", F.min), ("hi", F.max))])
    return masks.overlapping_boxes(b, 8).select("a", "b", "contains", F.col("union.lo_y").alias("lo_y"), F.col("union.hi_x").alias("hi_x"))


@query("z15_noise_level", f"with {EMB}, {MEAN} select round(greatest(quantile_cont(v, 0.5)-min(v), 100*2.220446049250313e-16*greatest(1.0, max(abs(v)))), 6) level from im")
def _(s, d):
    return online.noise_level(projections.mean(emb(s, d))).select(r6("level").alias("level"))


@query("z16_detect_in_tiles")
def _(s, d):
    return online.detect_in_tiles(projections.mean(emb(s, d)), 20, 25, 8, 3, 0.02, 2).select(r6("y", 3).alias("y"), r6("x", 3).alias("x"), "n")


@query("z25_latest_time_course", f"with {EMB}, {ROI}, tq as (select roi, t, avg(v) v from mv join rp using (y, x) group by roi, t), rn as (select 0 run, roi, t, v tc from tq union all select 1, roi, t, 2*v from tq where roi % 2 = 0) select roi, t, round(tc, 6) + 0.0 tc from rn where run = case when roi % 2 = 0 then 1 else 0 end")
def _(s, d):
    tq = emb_traces(s, d)
    runs = tq.select(F.lit(0).alias("run"), "roi", "t", F.col("v").alias("tc")).union(tq.filter("roi % 2 = 0").select(F.lit(1), "roi", "t", 2 * F.col("v")))
    return transients.latest_time_course(runs).select("roi", "t", r6("tc").alias("tc"))


@query("z25_scale_for_display", f"with {EMB}, {ROI}, tq as (select roi, t, avg(v) v from mv join rp using (y, x) group by roi, t), m as (select roi, max(abs(v))/max(abs(v*v)) s from tq group by roi) select roi, t, round(v*v*s, 6) v from tq join m using (roi)")
def _(s, d):
    tq = emb_traces(s, d)
    return transients.scale_for_display(tq.select("roi", "t", (F.col("v") * F.col("v")).alias("tc")), tq).select("roi", "t", r6().alias("v"))


@query("d18_plot_order", f"with {EMB}, {ROI}, tq as (select roi, t, avg(v) v from mv join rp using (y, x) group by roi, t) select roi, t trans, row_number() over (partition by roi order by round(v, 9) desc, t)-1 place from tq")
def _(s, d):
    return transients.plot_order(emb_traces(s, d).select("roi", F.col("t").alias("trans"), F.round("v", 9).alias("r")), "r").select("roi", "trans", F.col("place").cast("bigint").alias("place"))


@query("d18_neighbour_cells", "with c as (select distinct cast(label as int) roi from embeddings) select roi, lag(roi) over (order by roi) before, lead(roi) over (order by roi) \"after\" from c")
def _(s, d):
    return transients.neighbour_cells(movie.embedding_labels(s, d).select("roi").distinct())


@query("q10_assess", f"with {EMB}, g as ({imaging._gauss_sql('t', 'y x', 1.0).format(src='mv')}), rs as (select mv.y, mv.x, mv.t, mv.v-g.v v from mv join g on g.y=mv.y and g.x=mv.x and g.t=mv.t), {imaging._lcorr()}, {imaging._lcorr('g', '2')}, {imaging._failures('rs')} select round((select sum(v*v) from rs)/(select sum(v*v) from mv), 5) fraction, round((select avg(v) from lc), 5) correlation_before, round((select avg(v) from lc2), 5) correlation_after, (select n from fa) failures")
def _(s, d):
    from lumiframe.operators import denoise

    m = emb(s, d)
    return denoise.assess(m, denoise.gaussian(m, 0, 1.0)).select(*[r6(c, 5).alias(c) for c in ("fraction", "correlation_before", "correlation_after")], "failures")


@query("s14_encode_frames", f"with {EMB} select y, x, t, round(cast(cast(v as float) as double), 5) + 0.0 v from mv")
def _(s, d):
    from lumiframe.sources import readers

    return image(readers.decode_frames(readers.encode_frames(emb(s, d))), digits=5)


@query("v7_region_status", f"with {ROI}, r as (select distinct roi from rp) select (select count(*) from r where roi % 3 <> 0) rois_committed, (select count(*) from r where roi % 3 = 0) rois_deleted, (select count(*) from rp where roi % 3 <> 0) pixels")
def _(s, d):
    done = _session(s, d)
    told = done.steps[-1].metrics
    return done.pixels.agg(F.count(F.lit(1)).alias("pixels")).select(F.lit(told["rois_committed"]).cast("bigint").alias("rois_committed"), F.lit(told["rois_deleted"]).cast("bigint").alias("rois_deleted"), "pixels")
