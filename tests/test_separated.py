"""Separated pixels against the plain greedy choice, in passes of a few pixels."""

import numpy as np
import pytest

from lumiframe.operators import movie, stats


def greedy(a, n, distance, descending=True):
    order = sorted(np.ndindex(a.shape), key=lambda p: (-a[p] if descending else a[p], p))
    out = []
    for p in order:
        if len(out) < n and all(sum((x - y) ** 2 for x, y in zip(p, q)) >= distance**2 for q in out):
            out.append(p)
    return out


RNG = np.random.default_rng(4)
IMAGES = {"noise": RNG.normal(size=(14, 17)), "ties": RNG.integers(0, 3, (12, 12)).astype(float), "ramp": np.add.outer(np.arange(15.0), np.zeros(9)), "flat": np.ones((9, 9))}


@pytest.mark.parametrize(("name", "n", "distance", "descending", "block"), [("noise", 30, 3, True, 20), ("noise", 12, 2.5, False, 4096), ("ties", 200, 1.5, True, 25), ("ramp", 20, 4, True, 30), ("flat", 40, 2, False, 17), ("flat", 5, 0, True, 2)])
def test_equals_the_greedy_choice(spark, name, n, distance, descending, block):
    a = IMAGES[name]
    image = movie.from_array(spark, a[..., None]).drop("t").repartition(3)
    got = stats.separated_pixels(image, n, distance, descending, block=block).orderBy("rank").collect()
    assert [(r["y"], r["x"]) for r in got] == greedy(a, n, distance, descending)
    assert [r["rank"] for r in got] == list(range(len(got)))


def test_nothing(spark):
    image = spark.createDataFrame([(0, 0, None)], "y int, x int, v double")
    assert stats.separated_pixels(image, 3, 2).count() == 0 and stats.separated_pixels(image, 0, 2).count() == 0
