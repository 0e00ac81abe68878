"""Motion correction over Spark: templates are tables, heavy ones reach the frames by shuffle; results equal the numpy twins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumiframe.functions import kernels as K
from lumiframe.functions import registration as R
from lumiframe.operators import movie as M
from lumiframe.operators import register, template

rng = np.random.default_rng(31)


@pytest.fixture(scope="module")
def drifting():
    base = K.blur(rng.normal(size=(26, 22)), 2) * 10
    return np.stack([R.apply_shift(base, (1.5 * np.sin(k / 3), k / 8)) for k in range(14)])


def as_rows(spark, m):
    return M.from_array(spark, np.moveaxis(m, 0, -1))


def shifts_of(df):
    return np.array([r["shift"] for r in df.orderBy("t").collect()])


@pytest.fixture(params=["light", "heavy"])
def weight(request, monkeypatch):
    if request.param == "heavy":
        monkeypatch.setattr(template, "LIGHT_BYTES", 0)
        monkeypatch.setattr(template, "SLAB_BYTES", 8 * 22 * 5)
    return request.param


def test_an_image_survives_packing(spark, weight, drifting):
    df = as_rows(spark, drifting[:1]).drop("t")
    packed = template.pack(df, (26, 22), M.PLANE)
    assert packed.light == (weight == "light") and packed.slabs.count() == (1 if weight == "light" else 6)
    assert np.array_equal(M.to_array(packed.image()), drifting[0])


def test_pixels_without_a_row_are_zero(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (2, 0, 3.0)], "y int, x int, v double")
    assert {tuple(r) for r in template.pack(df, (3, 2), M.PLANE).image().collect() if r.v} == {(0, 1, 2.0), (2, 0, 3.0)}


@pytest.mark.parametrize("rounds", [1, 2])
def test_rigid_equals_numpy(spark, weight, drifting, rounds):
    options = dict(upsample=20, bin_frames=6, first=4, rounds=rounds)
    out, shifts, end, start = register.rigid(as_rows(spark, drifting), **options)
    want, moves, last, begin = R.rigid(drifting, **options)
    assert np.allclose(shifts_of(shifts), moves) and shifts.count() == 14
    assert np.allclose(np.moveaxis(M.to_array(out), -1, 0), want)
    assert np.allclose(M.to_array(end), last) and np.allclose(M.to_array(start), begin)


def test_volumes_and_a_given_template(spark, weight):
    base = np.stack([K.blur(rng.normal(size=(16, 12)), 1) for _ in range(4)])
    vol = np.stack([np.roll(base, (k % 3, -(k % 2)), (1, 2)) for k in range(6)])
    df = M.from_array(spark, np.moveaxis(vol, 0, -1), M.VOLUME)
    given = M.from_array(spark, base[..., None], M.VOLUME).drop("t")
    _, shifts, _, start = register.rigid(df, upsample=1, bin_frames=6, keys=M.VOLUME, template=given)
    assert np.allclose(shifts_of(shifts), [(0, -(k % 3), k % 2) for k in range(6)])
    assert np.array_equal(M.to_array(start, M.VOLUME), base)


@pytest.mark.parametrize("method, options", [("patch", {"grid": 11}), ("patchwarp", {"parts": 2, "iterations": 8})])
def test_finer_methods_equal_numpy(spark, weight, drifting, method, options):
    common = dict(upsample=10, bin_frames=7, first=4)
    out, shifts, *_ = register.correct(as_rows(spark, drifting), method, **options, **common)
    twin = R.piecewise if method == "patch" else R.affine_patches
    if method == "patchwarp":
        common.pop("first")
    want, moves, *_ = twin(drifting, **options, **common)
    assert np.allclose(shifts_of(shifts), moves)
    assert np.allclose(np.moveaxis(M.to_array(out), -1, 0), want)


def test_gaps_and_empty_movies(spark, weight, drifting):
    df = as_rows(spark, drifting).filter("t < 4 or t >= 12")
    out, shifts, *_ = register.rigid(df, upsample=4, bin_frames=4, first=4)
    assert sorted(r["t"] for r in shifts.collect()) == [0, 1, 2, 3, 12, 13]
    assert out.count() == df.count() and out.filter(F.isnan("v")).isEmpty()
    for method in register.METHODS:
        assert all(x.isEmpty() for x in register.correct(df.filter("t < 0"), method))


def test_a_heavy_template_never_passes_the_driver(spark, drifting, monkeypatch):
    monkeypatch.setattr(template, "LIGHT_BYTES", 0)
    packed = template.pack(as_rows(spark, drifting[:1]).drop("t"), (26, 22), M.PLANE)
    monkeypatch.setattr(type(packed.slabs), "collect", lambda self: pytest.fail("collected"))
    moved = template.per_frame(as_rows(spark, drifting), packed, lambda ref, f: (f, np.zeros(2)), (0, 14))
    assert moved.filter("shift is not null").count() == 14


def test_subpixel_correlation_is_the_inverse_transform_at_whole_places():
    a, b = rng.normal(size=(2, 9, 8))
    cross = np.fft.fftn(a) * np.conj(np.fft.fftn(b))
    assert np.allclose(R.correlation_at(cross, [np.arange(9), np.arange(8)]) / 72, np.abs(np.fft.ifftn(cross)))
