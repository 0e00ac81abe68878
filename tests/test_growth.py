"""Steps whose cost must not grow faster than the movie: their plans and what they hold."""

import numpy as np
import pytest

from lumiframe.operators import masks, movie, patches


@pytest.mark.parametrize("size, extent, overlap", [(411, 8, 2), (8, 8, 2), (9, 8, 2), (14, 8, 2), (15, 8, 2), (100, 10, 0), (25, 10, 3), (3, 8, 2), (37, 7, 6)])
def test_patches_by_arithmetic(spark, size, extent, overlap):
    begin = patches.starts(size, extent, overlap)
    got = patches.assign(spark.range(size).withColumnRenamed("id", "y"), {"y": (begin, extent)}).collect()
    assert sorted((r.y, r.patch) for r in got) == sorted((y, k) for k, s in enumerate(begin) for y in range(s, min(s + extent, size)))
    table = patches.patch_table(spark, (size, 25), (extent, 10), (overlap, 3)).orderBy("patch").collect()
    assert [tuple(r) for r in table] == [(k, *a, *b) for k, (a, b) in enumerate(patches.boxes((size, 25), (extent, 10), (overlap, 3)))]


def test_irregular_starts_are_kept(spark):
    got = patches.assign(spark.range(20).withColumnRenamed("id", "y"), {"y": ([0, 3, 11, 12], 4)}).collect()
    assert sorted((r.y, r.patch) for r in got) == sorted((y, k) for k, s in enumerate([0, 3, 11, 12]) for y in range(s, s + 4))


def test_plans_do_not_hold_every_patch(spark):
    held = patches.assign(spark.range(9).withColumnRenamed("id", "y"), {"y": (patches.starts(100_000, 8, 2), 8)})
    assert len(held._jdf.queryExecution().analyzed().toString()) < 10_000


def test_overlapping_boxes_are_told_once_without_an_aggregate(spark):
    r = np.random.default_rng(5)
    lo, size = r.integers(-40, 60, (60, 2)), r.integers(0, 50, (60, 2))
    rows = [(k, *map(int, (*lo[k], *(lo[k] + size[k])))) for k in range(60)]
    got = masks.overlapping_boxes(spark.createDataFrame(rows, "roi int, lo_y int, lo_x int, hi_y int, hi_x int"), 8)
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if (lo[a] <= lo[b] + size[b]).all() and (lo[b] <= lo[a] + size[a]).all()}
    pairs = [(p.a, p.b) for p in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("border", ["reflect", "nearest"])
def test_a_blur_holds_no_matrix_of_the_field(border):
    from lumiframe.functions import kernels

    image = np.random.default_rng(1).normal(size=(9, 4, 2))
    a, b = (kernels.gaussian_matrix(n, 1.5, border) for n in (9, 4))
    assert np.allclose(kernels.blur(image, 1.5, border), np.einsum("ij,jkc,lk->ilc", a, image, b))
    assert np.allclose(kernels.blur(np.ones((200_000, 3)), 1.0, border), 1)  # as a matrix: 320 GB


def test_online_extraction_takes_frames_one_by_one(spark):
    """The same cells as from the whole movie in memory, with a frame and some pixels missing and batches that cut frames."""
    from lumiframe.plans.extraction import cells_movie
    from lumiframe.streaming import online

    m = cells_movie(t=60)
    m[..., 7], m[3, :5] = 0, 0
    options = dict(detection=online.Detection(cutoff=3.0, least_pixels=6), promotion=online.Promotion(after=3))
    df = movie.from_array(spark, m).filter("t <> 7 and not (y = 3 and x < 5)")
    state, _ = online.track_array(m, **options)
    want = sorted((k, int(y) + q.y, int(x) + q.x, float(q.v[y, x])) for k, q in enumerate(state.profiles) for y, x in np.argwhere(q.v > 0))
    plan = online.extract_online(df, m.shape[:2], **options)
    assert want and sorted(tuple(r) for r in plan.collect()) == want
    assert "FlatMapGroups" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_what_registration_reads_is_made_once(spark):
    from lumiframe.plans import extraction

    plan = extraction._drifting(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
