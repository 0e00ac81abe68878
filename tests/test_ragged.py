"""Tables whose last row of pixels, plane or volume isn't full: the named queries give their SQL's rows."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumiframe.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def ragged(spark, tmp_path_factory):
    """The first 456 vectors: the last row of 25 pixels has 6, the last plane of 100 has 56, the last of its lines 6."""
    d = tmp_path_factory.mktemp("ragged")
    duckdb.sql(f"copy (select * from '{SF}/embeddings.parquet' where vec_id < 456) to '{d}/embeddings.parquet'")
    return str(d)


def rows_of(df):
    return sorted(map(repr, (tuple(None if v is None else float(v) for v in r) for r in df)))


def same_as_sql(spark, d, name, tables=("embeddings",)):
    got = registry.queries()[name](spark, d)
    c = duckdb.connect()
    for t in tables:
        c.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = c.sql(registry.oracle_sql()[name]).project(", ".join(f'"{x}"' for x in got.columns)).fetchall()
    assert rows_of(got.collect()) == rows_of(want)


def test_interleaved_slices(spark, ragged):
    same_as_sql(spark, ragged, "s10_interleaved_slices")


def test_encoded_frames(spark, ragged):
    same_as_sql(spark, ragged, "s14_encode_frames")


def test_absent_pixels_and_nan_samples_differ(spark):
    from lumiframe.sources import readers

    df = spark.createDataFrame([(0, 0, 0, float("nan")), (1, 2, 0, 2.0)], "y int, x int, t int, v double")
    for kind in ("fits", "tiff"):
        got = sorted((r.y, r.x, r.v) for r in readers.decode_frames(readers.encode_frames(df, kind), kind).collect())
        assert [g[:2] for g in got] == [(0, 0), (1, 2)] and got[1][2] == 2.0


def test_downsampled_volume(spark, tmp_path):
    duckdb.sql(f"copy (select vec_id + 1000*k vec_id, embedding, label from '{SF}/embeddings.parquet', range(3) g(k) where vec_id + 1000*k < 2456) to '{tmp_path}/embeddings.parquet'")
    same_as_sql(spark, str(tmp_path), "v1_downsample")


@pytest.mark.parametrize("name", ["q1_gaussian_space", "q12_blur_movie", "q13_blur_nearest"])
def test_gaussians(spark, ragged, name):
    same_as_sql(spark, ragged, name)


@pytest.mark.parametrize("border", ["reflect", "nearest"])
def test_gaussian_over_gaps(spark, border):
    """Samples inside a line and at both of its ends are missing: they add nothing, and borders stay the field's."""
    from lumiframe.functions.kernels import gaussian_taps
    from lumiframe.operators import denoise

    v = np.random.default_rng(3).normal(size=12)
    there = [k for k in range(12) if k not in (0, 1, 5, 6, 11)]
    df = spark.createDataFrame([(0, k, 0, float(v[k])) for k in there] + [(1, 11, 0, 1.0)], "y int, x int, t int, v double")
    taps, at = gaussian_taps(1.0), {}
    for k in there:
        for j, w in enumerate(taps):
            z = k + j - len(taps) // 2
            z = min(max(z, 0), 11) if border == "nearest" else (-1 - z if z < 0 else 23 - z if z > 11 else z)
            at[k] = at.get(k, 0) + w * (v[z] if z in there else 0)
    got = {r.x: r.v for r in denoise.axis_pass(df, "x", 1.0, 12, ("y", "x"), border).filter("y = 0").collect()}
    assert got.keys() == at.keys() and all(abs(got[k] - at[k]) < 1e-12 for k in at)


def test_median_in_space(spark, ragged):
    same_as_sql(spark, ragged, "q2_median_space")


@pytest.mark.parametrize("time", [1, 3])
def test_windows_with_few_samples_have_no_median(spark, time):
    """Both ways of the median: rank 4 of nine (13 of 27) cells, missing ones last; none where there are fewer; no row where there was none."""
    from lumiframe.operators import denoise

    cells = [(0, 0, 1.0), (0, 1, 2.0), (3, 3, 3.0), (1, 1, 5.0)]
    df = spark.createDataFrame([(y, x, t, v) for y, x, v in cells for t in range(3)], "y int, x int, t int, v double")
    got = {(r.y, r.x): r.v for r in denoise.median(df, 3, time).filter("t = 1").collect()}
    # (0, 0): its border repeats 1.0 four times and 2.0 twice, and 5.0 stands once; (0, 1): 1.0 and 2.0 twice, and 5.0
    assert got == {(0, 0): 2.0, (0, 1): 5.0, (1, 1): None, (3, 3): None}


def test_registration_of_a_ragged_volume(spark, tmp_path):
    """The first plane of eleven is whole, the last has 56 cells: what is absent doesn't move, and holds no frame fast."""
    from lumiframe.functions import kernels
    from lumiframe.operators import movie, register

    r = np.random.default_rng(8)
    base = 10 + kernels.blur(r.normal(size=(14, 14)), 1)
    vol = np.stack([np.stack([base, base])[:, 2 - dy : 12 - dy, 2 - dx : 12 - dx] for dy, dx in ((0, 0), (0, 0), (0, 0), (1, 1), (-1, 1), (1, -1), (-1, 0))])
    df = movie.from_array(spark, np.moveaxis(vol, 0, -1), movie.VOLUME).filter("l = 0 or 10*w + d < 56")
    shifts = register.rigid(df, most=3, upsample=1, bin_frames=8, first=3, keys=movie.VOLUME)[1].orderBy("t").collect()
    assert [tuple(int(x) for x in s["shift"]) for s in shifts] == [(0, 0, 0)] * 3 + [(0, -1, -1), (0, 1, -1), (0, -1, 1), (0, 1, 0)]


def test_blocks_that_end_before_they_begin(spark, tmp_path):
    """Hours before 2024 make such blocks; equal ones, and rows without a time, stay as the SQL has them."""
    rows = "('2023-12-30 20:30:00', 3), ('2023-12-30 20:40:00', 3), ('2023-12-31 23:10:00', 0), ('2023-12-31 23:20:00', 0), ('2024-01-02 01:00:00', 0), (null, 0), (null, 7), (null, 7)"
    duckdb.sql(f"copy (select row_number() over () event_id, ts::timestamp ts, u::bigint user_id, 'a' event_type, 1.0 as value, '{{}}' props from (values {rows}) z(ts, u)) to '{tmp_path}/events.parquet'")
    same_as_sql(spark, str(tmp_path), "z7_merge_blocks", ("events",))
