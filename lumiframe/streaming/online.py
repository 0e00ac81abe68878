"""Online detection: frames arrive one by one, known cells are fitted, and what they don't explain can become a new cell.

State is kept for each movie, so movies run in parallel and the frames of one stay in order. Frames of a micro-batch are sorted; frames at
or before the last one seen are passed over, so a replay after a failure changes nothing. State lives in the state store, not in the
process: a map of cells, one of candidates, one of the frames that the look-ahead holds and one of tiles with rejected pixels. Cells and candidates
are patches of their own pixels, so the state grows with those, and a micro-batch writes only the entries that it has changed.
"""

from __future__ import annotations

import itertools
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumiframe.functions import kernels, solvers
from lumiframe.operators.contamination import DEFAULTS, CellWindow


@dataclass(frozen=True)
class Detection:
    """``least_mean``: the least mean brightness of a spot; under zero, so many times its local noise. ``sections``: the grid of the noise map. ``grow``: spots are
    widened by a square of that reach before they are told apart. ``most_extent``: spots that are longer in either direction are left out for good. ``confirm``: a new candidate must also have weight in
    a penalised fit of small spots to its own region."""

    cutoff: float = 4.0
    blur: float = 1.0
    least_pixels: int = 50
    least_mean: float = -1.0
    grow: int = 0
    most_extent: int | None = None
    sections: tuple[int, int] = (1, 1)
    confirm: bool = False


@dataclass(frozen=True)
class Promotion:
    """``least_fit``: a candidate's match with a frame is undone if its own shape fits the frame with at most so many times the local noise (0: never). ``brightest``,
    ``symmetry``: of two profiles, one within the other, the outer one is split if the inner one is less than ``brightest`` times fainter there and the smaller containment at most
    ``symmetry`` of the larger."""

    least_fit: float = 0.0
    brightest: float = 2.0
    symmetry: float = 0.75
    after: int = 5
    gap: int = 1
    distance: float = 5.0
    overlap: float = 0.75
    containment: float = 0.75


@dataclass(frozen=True)
class Fit:
    lookahead: int = 3
    pad: int = 10
    tol: float = 0.01
    options: tuple = ()


Box = tuple[slice, slice]


@dataclass
class Patch:
    """An image that is zero outside a rectangle."""

    y: int
    x: int
    v: np.ndarray

    @property
    def box(self) -> Box:
        return slice(self.y, self.y + self.v.shape[0]), slice(self.x, self.x + self.v.shape[1])

    @classmethod
    def cut(cls, image: np.ndarray, box: Box, dtype=np.float32) -> Patch:
        return cls(box[0].start, box[1].start, np.array(image[box], dtype))

    @classmethod
    def of(cls, image: np.ndarray, y: int = 0, x: int = 0) -> Patch:
        """The smallest one that holds the positive pixels of an image whose corner is at (y, x)."""
        at = np.argwhere(image > 0)
        (a, b), (c, d) = at.min(0), at.max(0) + 1
        return cls(int(a) + y, int(b) + x, np.array(image[a:c, b:d], float))

    def within(self, box: Box) -> np.ndarray:
        """Its pixels on another rectangle, zero where it has none."""
        out = np.zeros((box[0].stop - box[0].start, box[1].stop - box[1].start))
        lo = max(self.y, box[0].start), max(self.x, box[1].start)
        hi = min(self.box[0].stop, box[0].stop), min(self.box[1].stop, box[1].stop)
        if lo[0] < hi[0] and lo[1] < hi[1]:
            out[lo[0] - box[0].start : hi[0] - box[0].start, lo[1] - box[1].start : hi[1] - box[1].start] = self.v[lo[0] - self.y : hi[0] - self.y, lo[1] - self.x : hi[1] - self.x]
        return out

    def dense(self, shape: tuple[int, int]) -> np.ndarray:
        return self.within((slice(0, shape[0]), slice(0, shape[1])))

    def meets(self, box: Box) -> bool:
        return all(a.start < b.stop and b.start < a.stop for a, b in zip(self.box, box, strict=True))


def around(boxes: list[Box], pad: int = 0, shape: tuple[int, int] | None = None) -> Box:
    """The rectangle around rectangles, widened by ``pad`` within ``shape``."""
    lo, hi = ([min(b[k].start for b in boxes) - pad for k in (0, 1)], [max(b[k].stop for b in boxes) + pad for k in (0, 1)])
    return tuple(slice(max(0, a) if shape else a, min(n, z) if shape else z) for a, z, n in zip(lo, hi, shape or (0, 0), strict=True))


def bounds(pixels: set) -> Box:
    ys, xs = zip(*pixels, strict=True)
    return slice(min(ys), max(ys) + 1), slice(min(xs), max(xs) + 1)


@dataclass
class Track:
    """A candidate: where it was seen last, how often, its pixels, and what its frames left there, of which it has at most as many as promotion takes."""

    centre: tuple[float, float]
    pixels: set
    last: int
    seen: int = 1
    crops: list[Patch] = field(default_factory=list)
    id: int = 0

    def shape(self) -> Patch:
        """The mean of its frames on its pixels; of each pixel over the frames that have it."""
        box = bounds(self.pixels)
        total, times, on = np.zeros_like(x := np.zeros((box[0].stop - box[0].start, box[1].stop - box[1].start))), np.zeros_like(x), np.zeros_like(x, bool)
        for c in self.crops:
            total += c.within(box)
            times += Patch(c.y, c.x, np.ones_like(c.v)).within(box)
        at = np.array(list(self.pixels)) - (box[0].start, box[1].start)
        on[tuple(at.T)] = True
        return Patch(box[0].start, box[1].start, np.where(on & (times > 0), total / np.maximum(times, 1), 0))


@dataclass
class State:
    shape: tuple[int, int]
    detection: Detection = Detection()
    promotion: Promotion = Promotion()
    fit: Fit = Fit()
    last: int = -1
    born: int = 0
    profiles: list[Patch] = field(default_factory=list)
    tracks: list[Track] = field(default_factory=list)
    rejected: np.ndarray | None = None
    too_large: list = field(default_factory=list)
    buffer: list[np.ndarray] = field(default_factory=list)
    times: list[int] = field(default_factory=list)
    _windows: dict = field(default_factory=dict, repr=False)

    # fitting

    def _window(self, cell: int):
        if cell not in self._windows:
            box = around([self.profiles[cell].box], self.fit.pad, self.shape)
            near = [k for k, p in enumerate(self.profiles) if k == cell or p.meets(box)]
            self._windows[cell] = box, CellWindow(np.array([self.profiles[k].within(box) for k in near]), near.index(cell), tol=self.fit.tol, **dict(self.fit.options))
        return self._windows[cell]

    def _fit(self, frame: np.ndarray) -> list[float]:
        return [w.solve(frame[box])["tc"] for box, w in map(self._window, range(len(self.profiles)))]

    def _put(self, profile: Patch, cell: int | None = None) -> int:
        """Adds a cell, or gives one another profile; windows that see it are set up afresh."""
        gone = [profile] if cell is None else [profile, self.profiles[cell]]
        self._windows = {c: v for c, v in self._windows.items() if c != cell and not any(g.meets(v[0]) for g in gone)}
        if cell is None:
            self.profiles.append(profile)
            return len(self.profiles) - 1
        self.profiles[cell] = profile
        return cell

    # detection

    def _detect(self, residual: np.ndarray) -> list[tuple[tuple[float, float], set]]:
        """Bright, large enough, connected spots of the blurred residual, outside rejected places."""
        d = self.detection
        smooth = kernels.blur(residual, d.blur)
        noise = noise_map(smooth, d.sections)
        on = smooth - np.median(smooth) > d.cutoff * noise
        if self.rejected is not None:
            on &= ~self.rejected
        if d.grow:
            on = sliding_window_view(np.pad(on, d.grow), (2 * d.grow + 1, 2 * d.grow + 1)).any((2, 3))
        lab, n = kernels.label(on, corners=False)
        out = []
        for k in range(1, n + 1):
            at = np.argwhere(lab == k)
            if len(at) < d.least_pixels:
                continue
            lo, hi = at.min(0), at.max(0)
            if d.most_extent is not None and (hi - lo).max() >= d.most_extent:
                self.too_large.append((lo, hi))
                continue
            spot = tuple(at.T)
            if d.confirm and not self._confirmed(residual, at):
                continue
            if residual[spot].mean() >= (d.least_mean if d.least_mean >= 0 else -d.least_mean * noise[spot].mean()):
                out.append((tuple(at.mean(0)), set(map(tuple, at))))
        return out

    def _confirmed(self, residual: np.ndarray, at: np.ndarray) -> bool:
        """Whether the fit of small spots to what is left around a candidate puts weight on its pixels."""
        o = {**DEFAULTS, **dict(self.fit.options)}
        spot = solvers.gaussian_blob(o["spot_radius"])
        box = around([bounds(set(map(tuple, at.tolist())))], spot.shape[0] // 2, self.shape)
        basis = solvers.SpotBasis(spot, residual[box].shape)
        spread = lambda z: basis(z.reshape(basis.shape)).ravel()
        n = residual[box].size
        weights, _ = solvers.sparse_fit(spread, spread, residual[box].ravel(), np.full(n, 2 * o["sigma2"] * o["lambda_spot"]), n, self.fit.tol)
        return bool(weights.reshape(basis.shape)[tuple((at - (box[0].start, box[1].start)).T)].sum() > 0)

    def _crop(self, residual: np.ndarray, pixels: set) -> Patch:
        return Patch.cut(np.maximum(residual, 0), around([bounds(pixels)], self.fit.pad, self.shape))

    def _begin(self, centre, pixels: set, t: int, residual: np.ndarray) -> None:
        self.born += 1
        self.tracks.append(Track(centre, pixels, t, 1, [self._crop(residual, pixels)], self.born))

    def _reject(self, at) -> None:
        if self.rejected is None:
            self.rejected = np.zeros(self.shape, bool)
        self.rejected[at] = True

    def _merged(self, found: list) -> list:
        """Spots of one frame that are one candidate by ``one_candidate``, put together until none is left."""
        out: list = []
        for _, px in found:
            own = set(px)
            while True:
                same = [k for k, q in enumerate(out) if one_candidate(own, q, self.promotion.overlap)]
                if not same:
                    break
                for k in reversed(same):
                    own |= out.pop(k)
            out.append(own)
        return [(tuple(np.array(sorted(px)).mean(0)), px) for px in out]

    def _match(self, found: list, residual: np.ndarray, t: int) -> list[tuple[Track, tuple]]:
        """Nearest pairs of tracks and spots first, one to one; tracks unseen for too long end. Returns the matched tracks with what they were before."""
        p = self.promotion
        pairs = sorted((math.dist(tr.centre, c), i, j) for i, tr in enumerate(self.tracks) for j, (c, _) in enumerate(found))
        used_t, used_f, matched = set(), set(), []
        for dist, i, j in pairs:
            if dist > p.distance or i in used_t or j in used_f:
                continue
            used_t.add(i)
            used_f.add(j)
            tr = self.tracks[i]
            matched.append((tr, (tr.last, tr.seen)))
            tr.centre, tr.last, tr.seen = found[j][0], t, tr.seen + 1
            tr.pixels |= found[j][1]
            tr.crops.append(self._crop(residual, tr.pixels))
        self.tracks = [tr for tr in self.tracks if t - tr.last <= p.gap]
        for j, (c, px) in enumerate(found):
            if j in used_f:
                continue
            old = next((tr for tr in self.tracks if one_candidate(px, tr.pixels, p.overlap)), None)
            if old is None:
                self._begin(c, px, t, residual)
            else:  # a part of a candidate that is known already
                old.pixels |= px
        return matched

    def _explained(self, residual: np.ndarray) -> tuple[np.ndarray, dict[int, float]]:
        """What the candidates' shapes, fitted together, leave of a frame, and the peak of what each explains, by candidate."""
        shapes = [tr.shape() for tr in self.tracks]
        box = around([p.box for p in shapes])
        a = np.array([p.within(box).ravel() for p in shapes])
        weights = np.maximum(np.linalg.lstsq(a.T, residual[box].ravel(), rcond=None)[0], 0)
        rest = residual.copy()
        rest[box] -= (weights @ a).reshape(rest[box].shape)
        return rest, {tr.id: float(w * p.v.max()) for tr, w, p in zip(self.tracks, weights, shapes, strict=True)}

    def _undo(self, matched: list[tuple[Track, tuple]], peaks: dict[int, float], noise: np.ndarray, t: int) -> None:
        """Takes back the matches of this frame whose candidate's own shape is hardly there; it counts as unseen."""
        for tr, (last, seen) in matched:
            at = tuple(min(max(round(c), 0), n - 1) for c, n in zip(tr.centre, self.shape, strict=True))
            if peaks[tr.id] <= self.promotion.least_fit * noise[at]:
                tr.crops.pop()
                tr.last, tr.seen = last, seen
        self.tracks = [tr for tr in self.tracks if t - tr.last <= self.promotion.gap]

    def _promote(self) -> list[int]:
        new = []
        for tr in [x for x in self.tracks if x.seen >= self.promotion.after]:
            self.tracks.remove(tr)
            profile = tr.shape()
            if profile.v.max() <= 0:
                self._reject(tuple(np.array(sorted(tr.pixels)).T))
                continue
            profile = Patch.of(profile.v / profile.v.max(), profile.y, profile.x)
            known = [k for k, q in enumerate(self.profiles) if q.meets(profile.box)]
            if any(min(shares(profile, self.profiles[k])) >= self.promotion.containment for k in known):
                continue  # a known cell seen anew, which stays as it is
            for k in known:
                parts = split(profile, self.profiles[k], self.promotion, self.detection)
                if parts is None:
                    continue
                if parts[0] == "first":  # the known cell holds the new one: it keeps the rest
                    if parts[1] is not None:
                        self._put(parts[1], k)
                else:
                    profile = parts[1]
                    if profile is None:
                        break
            if profile is not None:
                new.append(self._put(profile))
        return new

    def step(self, t: int, frame: np.ndarray) -> list[tuple[int, int, float, bool]]:
        """(frame, cell, activity, new) rows; none while the lookahead fills, or for a frame that was seen before."""
        if t <= self.last:
            return []
        self.last = t
        self.buffer.append(np.asarray(frame, float))
        self.times.append(t)
        if len(self.buffer) < self.fit.lookahead:
            return []
        now, at = np.mean(self.buffer, axis=0), self.times[0]
        self.buffer.pop(0)
        self.times.pop(0)
        activity = self._fit(now)
        residual = now.copy()
        for a, p in zip(activity, self.profiles, strict=True):
            residual[p.box] -= a * p.v
        self.too_large = []
        matched = self._match(self._merged(self._detect(residual)), residual, at)
        if len(self.tracks) > 1 or self.tracks and self.tracks[0].seen > 1:
            # what the candidates explain together is taken away; what is bright still is a candidate of its own
            rest, peaks = self._explained(residual)
            known = set().union(*(tr.pixels for tr in self.tracks))
            if self.promotion.least_fit > 0 and matched:
                self._undo(matched, peaks, noise_map(kernels.blur(residual, self.detection.blur), self.detection.sections), at)
            for c, px in self._detect(rest):
                if not px & known:
                    self._begin(c, px, at, rest)
        for lo, hi in self.too_large:  # from the next frame on
            self._reject((slice(lo[0], hi[0] + 1), slice(lo[1], hi[1] + 1)))
        rows = [(at, k, a, False) for k, a in enumerate(activity)]
        for k in self._promote():
            box, w = self._window(k)
            rows.append((at, k, w.solve(residual[box])["tc"], True))
        return rows


def containment(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Shares of either profile's energy (sum of squares) that lie on the other: how nearly a fit by the whole profile is one by its common part."""
    ea, eb = float((a**2).sum()), float((b**2).sum())
    return (float((a[b > 0] ** 2).sum()) / ea if ea else 0.0), (float((b[a > 0] ** 2).sum()) / eb if eb else 0.0)


def shares(a: Patch, b: Patch) -> tuple[float, float]:
    """``containment`` of two patches."""
    box = around([a.box, b.box])
    return containment(a.within(box), b.within(box))


#: Of a profile's peak: what is less after another was taken off is rounding.
LEFT_OVER = 0.01


def split(a: Patch, b: Patch, promotion: Promotion, detection: Detection) -> tuple[str, Patch | None] | None:
    """Which of two profiles lies within the other ("first" or "second"), and what the other is without it; nothing if they aren't to be split.

    Either must lie within the other and not both in each other, and the inner one must be about as bright as the outer one there (else it is the same cell, weakly
    active). The outer one's rest is its largest connected part, of peak one, or None if that is too small."""
    box = around([a.box, b.box])
    p, q = a.within(box), b.within(box)
    in_b, in_a = containment(p, q)
    if (in_b >= promotion.containment) == (in_a >= promotion.containment) or min(in_a, in_b) > promotion.symmetry * max(in_a, in_b):
        return None
    inner, outer = (p, q) if in_b > in_a else (q, p)
    both = inner * (outer > 0)
    scale = float((both * outer).sum() / (both * both).sum())
    if not 0 < scale < promotion.brightest:
        return None
    rest = np.maximum(outer - scale * inner, 0)
    on = rest > LEFT_OVER * rest.max()
    if detection.grow:
        on = sliding_window_view(np.pad(on, detection.grow), (2 * detection.grow + 1, 2 * detection.grow + 1)).any((2, 3))
    lab, n = kernels.label(on, corners=False)
    sizes = np.bincount(lab.ravel(), minlength=n + 1)[1:]
    kept = np.where(lab == sizes.argmax() + 1, rest, 0) if n and sizes.max() >= detection.least_pixels else np.zeros_like(rest)
    part = Patch.of(kept / kept.max(), box[0].start, box[1].start) if kept.max() > 0 else None
    return "first" if in_b > in_a else "second", part


def split_profiles(profiles: DataFrame, containment: float = 0.75, brightest: float = 2.0, symmetry: float = 0.75) -> DataFrame:
    """(inner, outer, scale, y, x, w): of every two profiles (roi, y, x, w) of which one is to be split (see ``split``), what is left of the outer one, before its
    largest part is taken. Joins on pixels and on pairs only."""
    rho = containment_ratios(profiles).withColumn("hi", F.greatest("rho_a", "rho_b")).withColumn("lo", F.least("rho_a", "rho_b"))
    rho = rho.filter((F.col("hi") >= containment) & (F.col("lo") < containment) & (F.col("lo") <= symmetry * F.col("hi")))
    first = F.col("rho_a") > F.col("rho_b")
    pairs = rho.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("inner"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("outer"))
    on = profiles.filter("w > 0")
    out = pairs.join(on.select(F.col("roi").alias("outer"), "y", "x", F.col("w").alias("wo")), "outer")
    both = out.join(on.select(F.col("roi").alias("inner"), "y", "x", F.col("w").alias("wi")), ["inner", "y", "x"], "left")
    wi = F.coalesce("wi", F.lit(0.0))
    sums = both.groupBy("inner", "outer").agg((F.sum(wi * F.col("wo")) / F.sum(wi * wi)).alias("scale")).filter((F.col("scale") > 0) & (F.col("scale") < brightest))
    rest = both.join(sums, ["inner", "outer"]).withColumn("w", F.greatest(F.col("wo") - F.col("scale") * wi, F.lit(0.0)))
    peak = rest.groupBy("inner", "outer").agg(F.max("w").alias("peak"))
    return rest.join(peak, ["inner", "outer"]).filter(F.col("w") > LEFT_OVER * F.col("peak")).select("inner", "outer", "scale", "y", "x", "w")


def one_candidate(p: set, q: set, k: float = 0.75) -> bool:
    """Whether two sets of pixels are one candidate: they overlap, and either reaches out of the other by at most half the edge of its bounds, or the overlap is k of the smaller."""
    common = len(p & q)
    if not common:
        return False
    edge = lambda z: 2 * sum(max(c) - min(c) + 1 for c in zip(*z, strict=True))
    return len(p) - common <= edge(p) / 2 or len(q) - common <= edge(q) / 2 or common >= k * min(len(p), len(q))


def noise_map(image: np.ndarray, sections: tuple[int, int] = (1, 1)) -> np.ndarray:
    """The noise level (median minus minimum, see ``noise_level``) of each section of a grid, linear between the sections' centres and beyond the outer ones."""
    least = 100 * np.finfo(float).eps * max(1.0, float(np.abs(image).max()))
    cuts = [np.linspace(0, n, k + 1).astype(int) for n, k in zip(image.shape, sections, strict=True)]
    out = np.array([[max(float(np.median(z := image[a:b, c:d]) - z.min()), least) for c, d in itertools.pairwise(cuts[1])] for a, b in itertools.pairwise(cuts[0])])
    for axis, cut in enumerate(cuts):
        mid = (cut[:-1] + cut[1:]) / 2
        if len(mid) == 1:
            out = np.repeat(out, image.shape[axis], axis)
            continue
        at = np.arange(image.shape[axis])
        left = np.clip(np.searchsorted(mid, at, "right") - 1, 0, len(mid) - 2)
        share = ((at - mid[left]) / (mid[left + 1] - mid[left])).reshape((-1, 1) if axis == 0 else (1, -1))
        out = np.take(out, left, axis) * (1 - share) + np.take(out, left + 1, axis) * share
    return out


def containment_ratios(profiles: DataFrame) -> DataFrame:
    """(a, b, rho_a, rho_b) of all overlapping pairs of profiles (roi, y, x, w): sums of squares over an equi-join on pixels."""
    on = profiles.filter("w > 0")
    total = on.groupBy("roi").agg(F.sum(F.col("w") * F.col("w")).alias("s"))
    j = on.select(F.col("roi").alias("a"), "y", "x", F.col("w").alias("wa")).join(on.select(F.col("roi").alias("b"), "y", "x", F.col("w").alias("wb")), ["y", "x"]).filter("a < b")
    s = j.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wa")).alias("sa"), F.sum(F.col("wb") * F.col("wb")).alias("sb"))
    ta, tb = total.select(F.col("roi").alias("a"), F.col("s").alias("ta")), total.select(F.col("roi").alias("b"), F.col("s").alias("tb"))
    return s.join(ta, "a").join(tb, "b").select("a", "b", F.try_divide("sa", "ta").alias("rho_a"), F.try_divide("sb", "tb").alias("rho_b"))


def merge_candidates(regions: DataFrame, k: float = 0.75) -> DataFrame:
    """(a, b, common) of pairs that should merge: they overlap, and either lies nearly within the other's bounds' reach or the overlap is at least k of the smaller."""
    size = regions.groupBy("roi").agg(F.count(F.lit(1)).alias("n"), (2 * (F.max("y") - F.min("y") + 1 + F.max("x") - F.min("x") + 1)).alias("edge"))
    j = regions.select(F.col("roi").alias("a"), "y", "x").join(regions.select(F.col("roi").alias("b"), "y", "x"), ["y", "x"]).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    sa = size.select(F.col("roi").alias("a"), F.col("n").alias("na"), F.col("edge").alias("ea"))
    sb = size.select(F.col("roi").alias("b"), F.col("n").alias("nb"), F.col("edge").alias("eb"))
    d = j.join(sa, "a").join(sb, "b")
    ua, ub = F.col("na") - F.col("common"), F.col("nb") - F.col("common")
    return d.filter((ua <= F.col("ea") / 2) | (ub <= F.col("eb") / 2) | (F.col("common") >= k * F.least("na", "nb"))).select("a", "b", "common")


FRAMES = T.StructType([T.StructField("movie_id", T.StringType()), T.StructField("t", T.IntegerType()), T.StructField("frame", T.ArrayType(T.DoubleType()))])
RESULTS = T.StructType([T.StructField("movie_id", T.StringType()), T.StructField("frame_index", T.IntegerType()), T.StructField("cell_id", T.IntegerType()), T.StructField("activity", T.DoubleType()), T.StructField("is_new", T.BooleanType())])


#: Edge of the tiles in which rejected pixels are kept.
TILE = 64


class Tracker(StatefulProcessor):
    """A movie's ``State`` in keyed state: entries are read once a micro-batch, and those that differ afterwards are written."""

    def __init__(self, shape: tuple[int, int], detection: Detection, promotion: Promotion, fit: Fit):
        self.options = shape, detection, promotion, fit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", "last int, born int")
        self.maps = {k: handle.getMapState(k, "id int", "v binary") for k in ("cells", "tracks", "frames", "rejected")}

    def close(self) -> None:
        pass

    def _load(self) -> tuple[State, dict]:
        state = State(*self.options)
        if self.clock.exists():
            state.last, state.born = self.clock.get()
        held = {k: {key[0]: bytes(v[0]) for key, v in m.iterator()} if m.exists() else {} for k, m in self.maps.items()}
        of = lambda k: [pickle.loads(held[k][i]) for i in sorted(held[k])]
        state.profiles, state.tracks = of("cells"), of("tracks")
        state.times, state.buffer = sorted(held["frames"]), of("frames")
        for tile, raw in held["rejected"].items():
            box = self._tile(tile)
            state._reject(box)
            state.rejected[box] = np.unpackbits(np.frombuffer(raw, np.uint8), count=state.rejected[box].size).reshape(state.rejected[box].shape)
        return state, held

    def _tile(self, k: int) -> Box:
        across = -(-self.options[0][1] // TILE)
        return tuple(slice(i * TILE, (i + 1) * TILE) for i in divmod(k, across))

    def _entries(self, state: State) -> dict[str, dict[int, bytes]]:
        tiles = range(-(-state.shape[0] // TILE) * -(-state.shape[1] // TILE)) if state.rejected is not None else ()
        return {
            "cells": {k: pickle.dumps(p) for k, p in enumerate(state.profiles)},
            "tracks": {t.id: pickle.dumps(t) for t in state.tracks},
            "frames": {t: pickle.dumps(f) for t, f in zip(state.times, state.buffer, strict=True)},
            "rejected": {k: np.packbits(state.rejected[self._tile(k)]).tobytes() for k in tiles if state.rejected[self._tile(k)].any()},
        }

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, held = self._load()
        found = []
        p = pd.concat(list(rows)).sort_values("t")
        for t, f in zip(p["t"], p["frame"], strict=True):
            found += state.step(int(t), np.asarray(f, float).reshape(state.shape))
        self.clock.update((state.last, state.born))
        for name, new in self._entries(state).items():
            for k in held[name].keys() - new.keys():
                self.maps[name].removeKey((k,))
            for k, v in new.items():
                if held[name].get(k) != v:
                    self.maps[name].updateValue((k,), (v,))
        yield pd.DataFrame([(key[0], *r) for r in found], columns=RESULTS.names)


def track(frames: DataFrame, shape: tuple[int, int], detection: Detection = Detection(), promotion: Promotion = Promotion(), fit: Fit = Fit()) -> DataFrame:  # noqa: B008
    """``RESULTS`` of a stream (or of one batch of it) of ``FRAMES``. Keyed state needs the RocksDB state store, which is set for the session."""
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return frames.groupBy("movie_id").transformWithStateInPandas(Tracker(shape, detection, promotion, fit), RESULTS, "Append", "None")


def track_array(movie: np.ndarray, **options) -> tuple[State, list]:
    """The same over a movie with time last, in this process."""
    state = State(movie.shape[:2], **options)
    return state, [r for t in range(movie.shape[2]) for r in state.step(t, movie[..., t])]


def extract_online(movie: DataFrame, shape: tuple[int, int], **options) -> DataFrame:
    """(roi, y, x, w) of the cells that the online detector finds in a whole movie. Frames pass one task, as they must be in order; it holds one of them and the detector's state."""

    def one(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = State(shape, **options)
        for t, frame in whole_frames(it, shape):
            state.step(t, frame)
        for k, q in enumerate(state.profiles):
            y, x = np.nonzero(q.v > 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), k), pa.int32()), pa.array(y + q.y, pa.int32()), pa.array(x + q.x, pa.int32()), pa.array(q.v[y, x], pa.float64())], names=["roi", "y", "x", "w"])

    return movie.select("y", "x", "t", "v").repartition(1).sortWithinPartitions("t").mapInArrow(one, "roi int, y int, x int, w double")


def whole_frames(it: Iterator[pa.RecordBatch], shape: tuple[int, int]) -> Iterator[tuple[int, np.ndarray]]:
    """(t, frame) from frame 0 on, of batches (y, x, t, v) in the order of t; what has no row is zero."""
    now, frame, any_rows = 0, np.zeros(shape), False
    for b in it:
        y, x, t, v = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        cuts = [0, *(np.flatnonzero(t[1:] != t[:-1]) + 1).tolist(), len(t)] if len(t) else []
        for lo, hi in itertools.pairwise(cuts):
            while now < t[lo]:
                yield now, frame
                now, frame = now + 1, np.zeros(shape)
            frame[y[lo:hi], x[lo:hi]] = v[lo:hi]
        any_rows |= len(t) > 0
    if any_rows:
        yield now, frame


def noise_level(image: DataFrame) -> DataFrame:
    """One row: median minus minimum of an image, never under a hundred rounding errors of its scale."""
    eps = float(100 * np.finfo(float).eps)
    return image.agg(F.greatest(F.percentile("v", F.lit(0.5)) - F.min("v"), eps * F.greatest(F.lit(1.0), F.max(F.abs("v")))).alias("level"))


def detect_in_tiles(image: DataFrame, height: int, width: int, tile: int, halo: int, threshold: float, least_pixels: int = 1) -> DataFrame:
    """(tile, y, x, n): centres and sizes of connected spots above the threshold. Tiles overlap by their halo; a spot belongs to the tile
    whose core holds its centre, so it is reported once."""
    from lumiframe.operators.patches import tiles

    every = {t["tile"]: t for t in tiles(height, width, tile, halo)}
    table = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(v).alias(n) for n, v in zip(("y0", "y1", "x0", "x1"), t["read"], strict=True)]) for k, t in every.items()])
    own = F.filter(table, lambda z: F.col("y").between(z["y0"], z["y1"]) & F.col("x").between(z["x0"], z["x1"]))
    held = image.filter(F.col("v") > threshold).withColumn("tile", F.explode(F.transform(own, lambda z: z["k"])))

    def spots(p: pd.DataFrame) -> pd.DataFrame:
        t = every[int(p["tile"].iloc[0])]
        y0, y1, x0, x1 = t["read"]
        on = np.zeros((y1 - y0 + 1, x1 - x0 + 1), bool)
        on[p["y"] - y0, p["x"] - x0] = True
        lab, n = kernels.label(on, corners=False)
        rows = []
        for k in range(1, n + 1):
            at = np.argwhere(lab == k)
            c = at.mean(0) + (y0, x0)
            a, b, d, e = t["core"]
            if len(at) >= least_pixels and a <= round(c[0]) <= b and d <= round(c[1]) <= e:
                rows.append((t["tile"], float(c[0]), float(c[1]), len(at)))
        return pd.DataFrame(rows, columns=["tile", "y", "x", "n"])

    return held.groupBy("tile").applyInPandas(spots, "tile int, y double, x double, n int")
