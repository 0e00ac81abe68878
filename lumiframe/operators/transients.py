"""Transients of region traces: detection, shapes, classification carry-over, counts and lookups. A trace table has (roi, t, v)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumiframe.functions.columns import correlation
from lumiframe.functions.kernels import MAD_TO_STD
from lumiframe.operators.masks import offsets_table
from lumiframe.operators.movie import PLANE

Keys = Sequence[str]
NAMES = {1.0: "true", -1.0: "false", 0.0: "mixed", None: "unclassified"}


def thresholds(traces: DataFrame) -> DataFrame:
    """(roi, thr): the larger of five robust deviations and the 95th percentile."""
    mid = traces.groupBy("roi").agg(F.percentile("v", F.lit(0.5)).alias("m"), F.percentile("v", F.lit(0.95)).alias("p95"))
    dev = traces.join(mid, "roi").groupBy("roi").agg(F.percentile(F.abs(F.col("v") - F.col("m")), F.lit(0.5)).alias("mad"), F.max("p95").alias("p95"))
    return dev.select("roi", F.greatest(5 * F.col("mad") / MAD_TO_STD, F.col("p95")).alias("thr"))


def runs(flags: DataFrame, by: Sequence[str] = ("roi",)) -> DataFrame:
    """(by..., t0, t1, n): maximal runs of set flags at consecutive t, inclusive."""
    w = Window.partitionBy(*by).orderBy("t")
    on = flags.filter("flag").withColumn("g", F.col("t") - F.row_number().over(w))
    return on.groupBy(*by, "g").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count(F.lit(1)).alias("n")).drop("g")


def detect(traces: DataFrame, blur: int = 2, least: int = 6, threshold: Callable[[DataFrame], DataFrame] = thresholds) -> DataFrame:
    """(roi, trans, t0, t1): runs over the threshold, widened by ``blur`` frames on both sides, of at least ``least`` frames."""
    w = Window.partitionBy("roi").orderBy("t").rowsBetween(-blur, blur)
    over = traces.join(threshold(traces), "roi").withColumn("flag", F.max(F.col("v") > F.col("thr")).over(w))
    found = runs(over).filter(F.col("n") >= least)
    return found.select("roi", (F.row_number().over(Window.partitionBy("roi").orderBy("t0")) - 1).alias("trans"), "t0", "t1")


def pad(found: DataFrame, traces: DataFrame, before: int = 5, after: int = 5) -> DataFrame:
    """Transients widened within the recording; they may come to overlap."""
    last = traces.groupBy("roi").agg(F.max("t").alias("__last"))
    return found.join(last, "roi").select("roi", "trans", F.greatest(F.col("t0") - before, F.lit(0)).alias("t0"), F.least(F.col("t1") + after, F.col("__last")).alias("t1"))


def windows(centres: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """(roi, y0, y1, x0, x1): inclusive bounds of a square around each centre, clamped to the field."""
    lo = lambda c: F.greatest(F.round(F.col(c)) - radius, F.lit(0)).cast("int")
    hi = lambda c, n: F.least(F.round(F.col(c)) + radius, F.lit(n - 1)).cast("int")
    return centres.select("roi", lo("c_y").alias("y0"), hi("c_y", height).alias("y1"), lo("c_x").alias("x0"), hi("c_x", width).alias("x1"))


def shapes(movie: DataFrame, traces: DataFrame, found: DataFrame, bounds: DataFrame) -> DataFrame:
    """(roi, trans, y, x, shape, corr, mean) of every pixel of each transient's window.

    Transients are unrolled to frames, so the interval join becomes an equi-join on t; only frames and pixels of some transient are read on."""
    frames = found.join(bounds, "roi").withColumn("t", F.explode(F.sequence("t0", "t1"))).join(traces.withColumnRenamed("v", "tc"), ["roi", "t"])
    cells = frames.select("roi", "trans", "t", "tc", F.explode(F.sequence("y0", "y1")).alias("y"), "x0", "x1").withColumn("x", F.explode(F.sequence("x0", "x1"))).drop("x0", "x1")
    j = cells.join(movie, ["y", "x", "t"])
    return j.groupBy("roi", "trans", "y", "x").agg(F.try_divide(F.sum(F.col("v") * F.col("tc")), F.sum(F.col("tc") * F.col("tc"))).alias("shape"), correlation("tc", "v").alias("corr"), F.avg("v").alias("mean"))


def profile_correlation(shaped: DataFrame, profiles: DataFrame) -> DataFrame:
    """(roi, trans, r): correlation of each transient's shape with its region's profile (roi, y, x, w), zero where there is no weight."""
    j = shaped.join(profiles, ["roi", "y", "x"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    return j.groupBy("roi", "trans").agg(correlation("w", "shape").alias("r"))


def carry_over(new: DataFrame, old: DataFrame) -> DataFrame:
    """(roi, trans, class): a new transient (roi, trans, t0, t1) takes the class of an old one of the same times, or of those it
    overlaps if they agree and all have one; else none."""
    o = old.select("roi", F.col("t0").alias("s"), F.col("t1").alias("e"), "class")
    j = new.join(o, "roi", "left").where((F.col("s") <= F.col("t1")) & (F.col("e") >= F.col("t0")) | F.col("s").isNull())
    same = (F.col("s") == F.col("t0")) & (F.col("e") == F.col("t1"))
    got = j.groupBy("roi", "trans").agg(
        F.max(F.when(same, F.struct(F.lit(1).alias("k"), F.col("class").alias("c")))).alias("same"),
        F.min("class").alias("a"), F.max("class").alias("b"), F.count("class").alias("n"), F.count("s").alias("all"),
    )
    agreed = F.when((F.col("a") == F.col("b")) & (F.col("n") == F.col("all")), F.col("a"))
    got = got.select("roi", "trans", F.when(F.col("same").isNotNull(), F.col("same.c")).otherwise(agreed).alias("class"))
    return new.select("roi", "trans").join(got, ["roi", "trans"], "left")


def classify_by_correlation(correlations: DataFrame, threshold: float = 0.4) -> DataFrame:
    """True (1) at or over the threshold, false (-1) under it, none without a correlation."""
    return correlations.withColumn("class", F.when(F.col("r").isNull() | F.isnan("r"), None).when(F.col("r") >= threshold, 1.0).otherwise(-1.0))


def next_class(c: Column) -> Column:
    """Unclassified -> false -> true -> mixed -> unclassified."""
    return F.when(c.isNull(), -1.0).when(c == -1, 1.0).when(c == 1, 0.0)


def class_name(c: Column) -> Column:
    return F.when(c.isNull(), "unclassified").when(c == 1, "true").when(c == -1, "false").otherwise("mixed")


def counts(classes: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One row: transients of each class among cells (roi, artifact) that are no artifacts, and cells of either kind."""
    j = classes.join(artifacts.filter("not artifact").select("roi"), "roi", "left_semi")
    n = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("bigint")
    c = F.col("class")
    a = j.agg(n(c == 1).alias("n_true"), n(c == -1).alias("n_false"), n(c.isNull()).alias("n_unclassified"), n(c == 0).alias("n_mixed"))
    b = artifacts.agg(n(F.col("artifact")).alias("artifact_cells"), n(~F.col("artifact")).alias("good_cells"))
    return a.crossJoin(F.broadcast(b))


def unclassified_cells(classes: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Cells without any class that are no artifacts."""
    return classes.groupBy("roi").agg(F.count("class").alias("n")).filter("n = 0").join(artifacts.filter("not artifact"), "roi", "left_semi").select("roi")


def pixel_lookup(regions: DataFrame, grid: DataFrame, keys: Keys = PLANE) -> DataFrame:
    """(keys..., rois): the sorted regions on or next to each pixel."""
    near = offsets_table(regions.select("roi", *keys), [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)], keys).join(grid.select(*keys), list(keys), "left_semi")
    return near.groupBy(*keys).agg(F.sort_array(F.collect_set("roi")).alias("rois"))


def region_at(regions: DataFrame, keys: Keys = PLANE) -> DataFrame:
    """(keys..., roi): the first region that covers each pixel."""
    return regions.groupBy(*keys).agg(F.min("roi").alias("roi"))


def backdrop(profiles: DataFrame, keys: Keys = PLANE) -> DataFrame:
    """(keys..., v): the largest of the profiles, each scaled to a maximum of one."""
    top = profiles.groupBy("roi").agg(F.max("w").alias("__m"))
    return profiles.join(top, "roi").groupBy(*keys).agg(F.max(F.when(F.col("__m") > 0, F.col("w") / F.col("__m")).otherwise(0.0)).alias("v"))


def merge_blocks(blocks: DataFrame, by: Sequence[str] = ("roi",)) -> DataFrame:
    """(by..., t0, t1): inclusive ranges that overlap or touch, merged."""
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last("t0"), F.asc_nulls_last("t1"))
    seen = F.max("t1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    g = blocks.withColumn("__new", F.when(seen.isNull() | (F.col("t0") > seen + 1), 1).otherwise(0)).withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy(*by, "__g").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).drop("__g")


def merge_groups(regions: DataFrame, traces: DataFrame, least: float = 0.8, keys: Keys = PLANE) -> DataFrame:
    """(roi, group): regions that overlap and whose traces correlate are one; groups are closed over such pairs and named by their least region.

    Pairs come from an equi-join on pixels, correlations only for those pairs, the closure from star rounds on the pair table."""
    from lumiframe.operators.graph import closure

    a, b = regions.select("roi", *keys), regions.select(F.col("roi").alias("other"), *keys)
    pairs = a.join(b, list(keys)).filter(F.col("roi") < F.col("other")).select("roi", "other").distinct()
    tr = pairs.join(traces.withColumnRenamed("v", "x"), "roi").join(traces.select(F.col("roi").alias("other"), "t", F.col("v").alias("y")), ["other", "t"])
    edges = tr.groupBy("roi", "other").agg(correlation("x", "y").alias("r")).filter(F.col("r") >= least)
    return closure(regions.select("roi").distinct(), edges.select(F.col("roi").alias("a"), F.col("other").alias("b")))


def lookahead_mean(movie: DataFrame, frames: int = 3, keys: Keys = PLANE) -> DataFrame:
    """Mean of each sample and those after it; samples without a full window ahead are left out."""
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(0, frames - 1)
    return movie.withColumn("m", F.avg("v").over(w)).withColumn("n", F.count("v").over(w)).filter(F.col("n") == frames).select(*keys, "t", F.col("m").alias("v"))


def trailing_mean(movie: DataFrame, frames: int = 3, keys: Keys = PLANE) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(-(frames - 1), 0)
    return movie.select(*keys, "t", F.avg("v").over(w).alias("v"))


def plot_order(values: DataFrame, by: str, descending: bool = True) -> DataFrame:
    """(roi, trans, place): each cell's transients by a value, the best first; transients without one come last."""
    order = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return values.select("roi", "trans", (F.row_number().over(Window.partitionBy("roi").orderBy(order, "trans")) - 1).alias("place"))


def neighbour_cells(cells: DataFrame) -> DataFrame:
    """(roi, before, after) in the order of the numbers. One row a cell."""
    w = Window.orderBy("roi")
    return cells.select("roi", F.lag("roi").over(w).alias("before"), F.lead("roi").over(w).alias("after"))


def latest_time_course(runs_: DataFrame) -> DataFrame:
    """(roi, t, tc): of several runs (run, roi, t, tc) the latest that holds the cell."""
    last = runs_.groupBy("roi").agg(F.max("run").alias("run"))
    return runs_.join(last, ["roi", "run"]).select("roi", "t", "tc")


def scale_for_display(tc: DataFrame, reference: DataFrame) -> DataFrame:
    """(roi, t, v): time courses scaled so that their largest size is the reference trace's (roi, t, v) over the frames that both have."""
    j = tc.filter(F.col("tc").isNotNull() & ~F.isnan("tc")).join(reference, ["roi", "t"])
    s = j.groupBy("roi").agg(F.try_divide(F.max(F.abs("v")), F.max(F.abs("tc"))).alias("s"))
    return tc.join(s, "roi", "left").select("roi", "t", (F.col("tc") * F.coalesce("s", F.lit(1.0))).alias("v"))
