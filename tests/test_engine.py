import numpy as np
import pytest
from pyspark.sql import functions as F

from lumiframe import pipeline
from lumiframe.operators import contamination, denoise, masks, movie, normalize, projections, stats, transients
from lumiframe.plans import registry
from lumiframe.plans.extraction import cells_movie
from lumiframe.sources import folders, formats, readers
from lumiframe.streaming import online

SF = "/root/testdata/sf0.001"
rng = np.random.default_rng(1)


@pytest.fixture(scope="module")
def small():
    return rng.normal(size=(5, 6, 20))


def test_forms_round_trip(spark, small):
    df = movie.from_array(spark, small)
    assert np.array_equal(movie.to_array(df), small)
    assert np.array_equal(movie.to_array(movie.from_trace(movie.to_trace(df))), small)
    assert np.array_equal(movie.to_array(movie.from_frame(movie.to_frame(df), 6)), small)
    with pytest.raises(ValueError):
        movie.validate(df.drop("t"))
    assert movie.validate(df).dtypes == [("y", "int"), ("x", "int"), ("t", "int"), ("v", "double")]


def test_projections_match_numpy_however_dealt(spark, small):
    want = {projections.mean: small.mean(-1), projections.median: np.median(small, -1), projections.variance: small.var(-1)}
    for parts in (1, 7):
        df = movie.from_array(spark, small).repartition(parts)
        for op, image in want.items():
            assert np.allclose(movie.to_array(op(df)), image)
    df = movie.from_array(spark, small)
    assert np.allclose(movie.to_array(projections.mode(df)), movie.to_array(projections.mode_by_expression(df)))
    fano = movie.to_array(projections.fano_factor(df))
    assert (fano[small.mean(-1) <= 0] == 0).all()


def test_local_correlation_edges(spark):
    m = np.zeros((3, 3, 8))
    m[1, 1] = np.arange(8)
    assert (movie.to_array(projections.local_correlation(movie.from_array(spark, m))) == 0).all()
    m[:] = np.arange(8)
    assert np.allclose(movie.to_array(projections.local_correlation(movie.from_array(spark, m))), 1)


def test_plans_push_frame_limits_and_prune_columns(spark):
    m = spark.read.parquet(f"{SF}/lineitem.parquet")
    plan = folders.preview(m.select(F.col("l_linenumber").alias("t"), "l_tax"), 3)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_linenumber), LessThan(l_linenumber,3)]" in plan and "l_comment" not in plan.split("ReadSchema")[1]


def test_errors(spark, small):
    df = movie.from_array(spark, small)
    for call in (lambda: projections.depth(df, "sum"), lambda: normalize.baselines(df, "max"), lambda: masks.compute(df, "best"), lambda: denoise.wavelet_time(df, "db9"), lambda: contamination.classify(df, df, "x"), lambda: readers.read_movie(spark, "/x/a.mp4")):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(FileNotFoundError):
        readers.read_movie(spark, "/x/a.h5")
    with pytest.raises(ValueError):
        folders.deinterleave(spark.range(7).withColumnRenamed("id", "s"), 3)


def test_normalisation_of_constants(spark):
    df = movie.from_array(spark, np.full((2, 2, 4), 3.0))
    assert (movie.to_array(normalize.normalize(df, "mean", "robuststd")) == 0).all()
    assert normalize.describe("mode", "median", True, False) == "(pixel-mode, all-median)" and normalize.describe(None, None, False, False) == "[]"
    assert normalize.histogram(df, 4).agg(F.sum("n")).first()[0] == 16


def test_median_of_even_windows(spark, small):
    got = movie.to_array(denoise.median(movie.from_array(spark, small), 1, 4))
    pad = np.pad(small, [(0, 0), (0, 0), (2, 1)], "edge")
    want = np.sort(np.stack([pad[..., k : k + 20] for k in range(4)], -1))[..., 2]
    assert np.allclose(got, want)


def test_low_rank_blocks(spark):
    a = rng.normal(size=(10, 9, 3)) @ rng.normal(size=(3, 24))
    df = movie.from_array(spark, a)
    out = movie.to_array(denoise.low_rank(df, 3, (6, 6), 24, 2, 0))
    assert np.allclose(out, a)


def test_singular_values(spark, small):
    x = small.reshape(-1, 20)
    want = np.linalg.svd(x - x.mean(1, keepdims=True), compute_uv=False)[:5]
    assert np.allclose(stats.singular_values(movie.from_array(spark, small), 5), want)


def test_residual_of_a_mask_keeps_zeros(spark, small):
    df = movie.from_array(spark, small)
    m = masks.above(projections.mean(df), 0.0)
    out = movie.to_array(masks.apply(df, m))
    assert np.allclose(out, np.where((small.mean(-1) > 0)[..., None], small, 0))


def test_carry_over_rules(spark):
    new = spark.createDataFrame([(0, 0, 10, 20), (0, 1, 30, 40), (0, 2, 50, 60), (0, 3, 80, 90)], "roi int, trans int, t0 int, t1 int")
    old = spark.createDataFrame([(0, 10, 20, -1.0), (0, 31, 33, 1.0), (0, 35, 45, 1.0), (0, 50, 52, 1.0), (0, 55, 58, None)], "roi int, t0 int, t1 int, class double")
    got = {r.trans: r["class"] for r in transients.carry_over(new, old).collect()}
    assert got == {0: -1.0, 1: 1.0, 2: None, 3: None}


def test_robust_time_course_beats_least_squares(spark):
    y, x = np.mgrid[:24, :24]
    cell = np.exp(-((y - 12) ** 2 + (x - 10) ** 2) / 8)
    spot = np.exp(-((y - 12) ** 2 + (x - 14) ** 2) / 2)
    m = np.stack([cell * (k % 3 == 0) + spot * 8 * (k % 3 == 1) for k in range(9)], -1) + rng.normal(0, 0.01, (24, 24, 9))
    at = np.argwhere(cell > 0.05)
    pf = spark.createDataFrame([(0, int(a), int(b), float(cell[a, b])) for a, b in at], "roi int, y int, x int, w double")
    got = contamination.time_courses(movie.from_array(spark, m), pf, 24, 24, pad=3).toPandas().sort_values("t")
    wrong = got[got.t % 3 == 1]
    assert wrong.tc.abs().mean() < 0.5 * wrong.tc_lsq.abs().mean()
    assert got[got.t % 3 == 0].tc.mean() > 0.8


def _onset():
    y, x = np.mgrid[:30, :30]
    m = 0.05 * rng.normal(size=(30, 30, 40))
    m[..., 10:] += 5 * np.exp(-((y - 15) ** 2 + (x - 15) ** 2) / 8)[..., None]
    return m


OPTIONS = {"detection": online.Detection(cutoff=3, least_pixels=10), "promotion": online.Promotion(after=4)}


def test_online_detector_finds_an_onset_and_replays():
    m = _onset()
    state, rows = online.track_array(m, **OPTIONS)
    assert len(state.profiles) == 1 and [r for r in rows if r[3]][0][0] >= 10
    assert np.unravel_index(state.profiles[0].dense((30, 30)).argmax(), (30, 30)) in [(a, b) for a in (14, 15, 16) for b in (14, 15, 16)]
    assert state.step(5, m[..., 5]) == [] and state.last == 39
    assert not online.track_array(0.05 * rng.normal(size=(30, 30, 40)), **OPTIONS)[0].profiles


def _spot(y, x, r=3.0, shape=(40, 40)):
    a, b = np.mgrid[: shape[0], : shape[1]]
    z = np.exp(-((a - y) ** 2 + (b - x) ** 2) / (2 * r * r))
    return np.where(z > 0.05, z, 0)


def test_a_cell_of_two_is_split_when_one_is_seen_alone():
    """Two cells that flash together are one at first; when one of them is active alone, the known cell keeps the other."""
    noise = np.random.default_rng(2).normal(scale=0.02, size=(40, 40, 40))
    a, b = _spot(18, 13), _spot(18, 23)
    m = noise + (a + b)[..., None] * (np.arange(40) < 14) * 3
    options = {"detection": online.Detection(cutoff=3, least_pixels=10), "promotion": online.Promotion(after=4)}
    both, _ = online.track_array(m, **options)
    assert len(both.profiles) == 1
    state = online.State((40, 40), **options)
    state._put(online.Patch.of(a + b))
    state.tracks = [online.Track((18, 13), set(map(tuple, np.argwhere(a > 0))), 0, 4, [online.Patch.of(a)], 1)]
    assert state._promote() == [1]
    left = state.profiles[0].dense((40, 40))
    assert np.unravel_index(left.argmax(), left.shape) == (18, 23) and left.max() == 1
    assert np.corrcoef(left.ravel(), b.ravel())[0, 1] > 0.95
    state.profiles, state.tracks = [online.Patch.of(a)], [online.Track((18, 18), set(map(tuple, np.argwhere(a + b > 0))), 0, 4, [online.Patch.of(a + b)], 2)]
    assert state._promote() == [1]  # the other way round: what is new of the candidate
    assert np.corrcoef(state.profiles[1].dense((40, 40)).ravel(), b.ravel())[0, 1] > 0.95
    dim = online.split(online.Patch.of(a * 0.3), online.Patch.of(a + b), online.Promotion(), online.Detection())
    assert dim is None  # a faint part of one cell is no cell of its own
    assert online.split(online.Patch.of(a), online.Patch.of(b), online.Promotion(), online.Detection()) is None


def test_a_flash_is_undone():
    """A bright frame and dim matches after it: by place alone they make a cell; by the candidate's own shape they don't."""
    noise = np.random.default_rng(3).normal(scale=0.02, size=(40, 40, 12))
    m = noise + _spot(20, 20)[..., None] * np.array([5.0 if t == 3 else 0.4 if 3 < t < 8 else 0 for t in range(12)])
    run = lambda k: online.track_array(m, detection=online.Detection(cutoff=3, least_pixels=10), promotion=online.Promotion(after=3, least_fit=k), fit=online.Fit(lookahead=1))[0]
    assert len(run(0).profiles) == 1 and not run(20).profiles


def test_confirmation_by_spots():
    """A bright spot is confirmed by the fit of small spots, unless their penalty leaves no weight."""
    frame = np.random.default_rng(3).normal(scale=0.01, size=(40, 40)) + _spot(12, 12) * 2
    plain = online.State((40, 40), online.Detection(cutoff=3, least_pixels=10))
    strict = online.State((40, 40), online.Detection(cutoff=3, least_pixels=10, confirm=True))
    veto = online.State((40, 40), online.Detection(cutoff=3, least_pixels=10, confirm=True), fit=online.Fit(options=(("lambda_spot", 1e9),)))
    assert len(plain._detect(frame)) == len(strict._detect(frame)) == 1 and not veto._detect(frame)


def test_state_grows_with_the_pixels_of_cells():
    """Twenty cells of a 256 x 256 field are a few kilobytes each, not a field each."""
    import pickle

    state = online.State((256, 256), online.Detection(cutoff=3, least_pixels=10), online.Promotion(after=4))
    for k in range(20):
        state._put(online.Patch.of(_spot(20 + 10 * k, 30 + 9 * k, shape=(256, 256))))
    entries = online.Tracker((256, 256), state.detection, state.promotion, state.fit)._entries(state)
    assert len(entries["cells"]) == 20 and sum(map(len, entries["cells"].values())) < 20 * 8 * 20 * 20
    assert pickle.loads(entries["cells"][3]).dense((256, 256))[50, 57] == 1


def _mat(arrays, compress, end="<"):
    """A MAT 5 file, element by element."""
    import struct
    import zlib

    def element(kind, data):
        return struct.pack(end + "II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    out = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack(end + "H", 0x0100) + (b"IM" if end == "<" else b"MI")
    for name, a in arrays.items():
        cls, kind = {"float64": (6, 9), "uint16": (11, 4), "uint8": (9, 2)}[a.dtype.name]
        short = struct.pack(end + "I", len(name) << 16 | 1) + name.encode().ljust(4, b"\0") if len(name) <= 4 else element(1, name.encode())
        body = element(6, struct.pack(end + "II", cls, 0)) + element(5, np.array(a.shape, end + "i4").tobytes()) + short + element(kind, a.astype(a.dtype.newbyteorder(end)).tobytes(order="F"))
        whole = struct.pack(end + "II", 14, len(body)) + body
        if compress:
            z = zlib.compress(whole)
            whole = struct.pack(end + "II", 15, len(z)) + z
        out += whole
    return out


@pytest.mark.parametrize(("compress", "end"), [(False, "<"), (True, "<"), (False, ">")])
def test_mat_files(spark, tmp_path, compress, end):
    a = rng.integers(0, 4000, (4, 5, 6)).astype(np.uint16)
    arrays = {"dt": np.array([[0.1]]), "movie": a, "rate": np.arange(6.0).reshape(2, 3)}
    raw = _mat(arrays, compress, end)
    got = formats.read_mat(raw)
    assert set(got) == set(arrays) and all(np.array_equal(got[k], v) and got[k].dtype == v.dtype for k, v in arrays.items())
    (tmp_path / "m.mat").write_bytes(raw)
    assert np.array_equal(movie.to_array(readers.read_movie(spark, str(tmp_path / "m.mat"))), a)
    with pytest.raises(ValueError):
        formats.read_mat(b"x" * 200)
    with pytest.raises(ValueError, match="7.3"):
        formats.read_mat(b"\x89HDF\r\n\x1a\n")


def test_nan_ignoring_deviation_and_temporal_margin(spark):
    from lumiframe.operators import denoise, normalize

    v = rng.normal(size=101)
    df = spark.createDataFrame([(float(x),) for x in v] + [(float("nan"),), (None,)], "v double")
    want = np.median(np.abs(v - np.median(v))) / normalize.MAD_TO_STD
    assert abs(normalize.robust_std_of_known(df).first()[0] - want) < 1e-9
    assert [denoise.temporal_margin("gaussian", 1.3), denoise.temporal_margin("gaussian"), denoise.temporal_margin("median", time_window=5), denoise.temporal_margin("wavelet_time")] == [6, 0, 2, 0]


def test_containment_is_a_share_of_energy():
    a, b = np.array([[1.0, 2.0, 0.0]]), np.array([[0.0, 2.0, 1.0]])
    assert online.containment(a, b) == (0.8, 0.8)
    rng_ = np.random.default_rng(4)
    for _ in range(20):  # against the two fits it stands for
        a, b = (np.maximum(rng_.normal(size=(6, 6)), 0) for _ in range(2))
        part = np.where((a > 0) & (b > 0), a, 0)
        whole, common = (a * b).sum() / (a * a).sum(), (part * b).sum() / (part * part).sum()
        assert np.isclose(online.containment(a, b)[0], whole / common)


def test_noise_map_is_linear_between_sections():
    rng_ = np.random.default_rng(5)
    image = rng_.normal(size=(20, 30))
    assert np.allclose(online.noise_map(image), np.median(image) - image.min())
    got = online.noise_map(image, (2, 3))
    level = lambda z: np.median(z) - z.min()
    c = np.array([[level(image[10 * i : 10 * i + 10, 10 * j : 10 * j + 10]) for j in range(3)] for i in range(2)])
    assert np.allclose([got[5, 5], got[15, 25], got[10, 5], got[5, 10]], [c[0, 0], c[1, 2], (c[0, 0] + c[1, 0]) / 2, (c[0, 0] + c[0, 1]) / 2])
    assert np.isclose(got[0, 5], c[0, 0] - 0.5 * (c[1, 0] - c[0, 0]))  # goes on beyond the outer centres


def test_detection_leaves_out_what_is_dim_or_too_large():
    y, x = np.mgrid[:40, :40]
    frame = np.random.default_rng(1).normal(scale=0.05, size=(40, 40))
    frame[5:9, 5:9] += 2
    frame[15:17, 2:38] += 2
    state = online.State((40, 40), online.Detection(cutoff=3, blur=0, least_pixels=9, most_extent=12))
    state.too_large = []
    assert [tuple(np.round(c)) for c, _ in state._detect(frame)] == [(6, 6)] or len(state._detect(frame)) == 1
    assert state.too_large
    wide = online.State((40, 40), online.Detection(cutoff=3, blur=0, least_pixels=9, most_extent=12, grow=1))
    assert len(wide._detect(frame)[0][1]) == 36
    assert not online.State((40, 40), online.Detection(cutoff=3, blur=0, least_pixels=9, least_mean=-1000.0))._detect(frame)
    assert len(state._merged([((0, 0), {(1, 1), (1, 2), (1, 3)}), ((0, 0), {(1, 3), (1, 4)}), ((0, 0), {(9, 9)})])) == 2
    m = np.repeat(frame[..., None], 12, axis=2)
    done, _ = online.track_array(m, detection=online.Detection(cutoff=3, blur=0, least_pixels=9, most_extent=12), promotion=online.Promotion(after=4))
    assert len(done.profiles) == 1 and done.rejected[15:17, 2:38].all() and not done.rejected[:12].any()


def test_stream_equals_batch(spark, tmp_path):
    m = _onset()
    _, want = online.track_array(m, **OPTIONS)
    rows = [("a", k, m[..., k].ravel().tolist()) for k in range(40)] + [("b", k, m[..., k].ravel().tolist()) for k in range(12)]
    df = spark.createDataFrame(rows, online.FRAMES)
    for n, lo in enumerate((0, 14, 27)):
        df.filter(f"t >= {lo} and t < {(14, 27, 40)[n]}").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    src = spark.readStream.schema(online.FRAMES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = online.track(src, (30, 30), **OPTIONS).writeStream.format("memory").queryName("tracked").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = sorted((r.frame_index, r.cell_id, round(r.activity, 6), r.is_new) for r in spark.table("tracked").filter("movie_id = 'a'").collect())
    assert got == sorted((a, b, round(c, 6), d) for a, b, c, d in want)


def test_files(spark, tmp_path):
    a = rng.integers(0, 4000, (4, 5, 6)).astype(np.uint16)
    np.save(tmp_path / "m.npy", a)
    assert np.array_equal(movie.to_array(readers.read_movie(spark, str(tmp_path / "m.npy"))), a)
    (tmp_path / "m.tif").write_bytes(formats.write_tiff(np.moveaxis(a, -1, 0)))
    assert np.array_equal(movie.to_array(readers.read_movie(spark, str(tmp_path / "m.tif"))), a)
    folder = tmp_path / "frames"
    folder.mkdir()
    for k in range(6):
        (folder / f"f{k}.{'tif' if k < 4 else 'tiff'}").write_bytes(formats.write_tiff(a[..., k]))
    assert np.array_equal(movie.to_array(readers.read_movie(spark, str(folder))), a)
    v = rng.normal(size=(3, 4, 5, 6)).astype(np.float32)
    (tmp_path / "v.fits").write_bytes(formats.write_fits(v))
    got = movie.to_array(readers.read_volumes(spark, str(tmp_path / "v.fits")), movie.VOLUME)
    assert np.allclose(np.moveaxis(got, -1, 0), v)
    with pytest.raises(ValueError):
        formats.read_fits(formats.write_fits(v[0]), 4)
    with pytest.raises(ValueError):
        formats.write_fits(v.astype(complex))
    assert readers.describe(spark, str(tmp_path / "m.npy")).startswith("1 file, ")
    assert readers.summary(readers.read_movie(spark, str(tmp_path / "m.npy"))) == "4 x 5 pixels, 6 frames"


def test_volume_folders(spark, tmp_path):
    v = np.arange(3 * 4 * 5 * 6).reshape(3, 4, 5, 6).astype(np.uint16)  # t, d, l, w
    for k in range(3):
        (tmp_path / f"{k}.tif").write_bytes(formats.write_tiff(v[k]))
    one = movie.to_array(readers.read_volume_folder(spark, str(tmp_path)), movie.VOLUME)
    assert np.array_equal(one, v.transpose(2, 3, 1, 0))
    two = movie.to_array(readers.read_volume_folder(spark, str(tmp_path), "interleaved", 2), movie.VOLUME)
    assert two.shape == (5, 6, 2, 6) and np.array_equal(two[..., 1, 0], v[0, 1])
    with pytest.raises(ValueError):
        readers.read_volume_folder(spark, str(tmp_path), "interleaved", 5).count()
    assert formats.largest_variable({"__x": np.zeros(99), "a": np.zeros(3), "b": np.zeros(5)}).size == 5


def test_session_round_trip(spark, tmp_path, small):
    df = movie.from_array(spark, small)
    s = pipeline.Session(spark).load(df, "p").commit(df, "Detrend", "detrending", {"window": 5}, {"x": 1.5})
    reg = spark.createDataFrame([(0, "m", "accepted", "{}"), (1, "m", "rejected", "{}")], pipeline.REGION)
    px = spark.createDataFrame([(0, 1, 1), (1, 2, 2)], "roi int, y int, x int")
    s.commit_regions(reg, px, "Cells").commit_regions(reg, px, "Cells")
    assert sorted(r.roi for r in s.regions.collect()) == [0, 1] and s.steps[-1].metrics == {"rois_committed": 1, "rois_deleted": 1}
    s.save(f"{tmp_path}/run_pipeline")
    back = pipeline.Session.restore(spark, f"{tmp_path}/run_output", lambda path: df if path == "p" else None)
    assert back.steps == s.steps and back.active is df and back.pixels.count() == 2
    assert "## 2. Detrend" in back.report() and "- window: 5" in back.report()
    assert back.clear_regions().labels == ["Load", "Detrend"]
    assert pipeline.advice("cnmf", {"one_photon"}) and not pipeline.advice("cnmf", {"dense"})


def test_pipeline_end_to_end(spark):
    df = movie.from_array(spark, cells_movie(t=60))
    out, mask, kept = masks.stage(normalize.normalize(df, "min", "median"), "otsu")
    assert 0 < kept.first()[0] < 1
    from lumiframe.operators import factor

    fp, tr = factor.extract_patches(df, (30, 30), (30, 30), 5, n=3)
    assert tr.select("roi").distinct().count() == fp.select("roi").distinct().count() >= 2
    found = transients.detect(tr, 1, 3)
    assert found.filter("t0 > t1").count() == 0


def test_a_cell_across_patches_is_one_mask(spark):
    """Two patches find one cell each; the merged mask counts a pixel once for each of them."""
    from lumiframe.operators import factor

    y, x = np.mgrid[:30, :40]
    trace = np.clip(np.random.default_rng(3).normal(size=80), 0, None)
    m = 0.02 * np.random.default_rng(4).normal(size=(30, 40, 80)) + np.exp(-((y - 15) ** 2 + (x - 20) ** 2) / 12)[..., None] * 3 * trace
    fp, tr = factor.extract_patches(movie.from_array(spark, m), (30, 40), (30, 26), 12, n=1)
    rows = fp.collect()
    assert len({r.roi for r in rows}) == 1 and {r.w for r in rows} == {1.0, 2.0}
    assert all(14 <= r.x <= 25 for r in rows if r.w == 2)
    centre = np.average([(r.y, r.x) for r in rows], axis=0, weights=[r.w for r in rows])
    assert np.hypot(*(centre - (15, 20))) < 2
    got = np.array([r.v for r in tr.orderBy("t").collect()])
    assert np.corrcoef(got, trace)[0, 1] > 0.95


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def _duck():
    import duckdb

    c = duckdb.connect()
    for t in ("embeddings", "events"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["p2_median_evt", "p7_local_correlation_emb", "p5_mode_expression", "n5_normalize_median_max_pp", "m2_otsu_mask", "t7_detrend", "q1_gaussian_space", "q2_median_space", "l1_ljung_box", "d7_transients", "d10_carry_over", "x7_neuropil_rings", "z7_merge_blocks"])
def test_oracles(spark, name):
    a, b = registry.queries()[name](spark, SF).toPandas(), _duck().sql(registry.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    rows = lambda df: sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))
    key = lambda df: rows(df.apply(lambda c: c.astype(float) if c.dtype.kind in "iuf" else c))
    assert key(a) == key(b)


@pytest.mark.parametrize("edge", [3, 5, 16])
def test_stencils_however_tiled(spark, edge, monkeypatch):
    """Tiles of any size, several blocks of frames and missing samples, against the plain expressions and against numpy; a volume too."""
    from lumiframe.operators import stencil

    monkeypatch.setitem(stencil.EDGE, 2, edge)
    monkeypatch.setattr(stencil, "BLOCK", 400)
    r = np.random.default_rng(edge)
    m = r.normal(size=(11, 9, 17))
    m[3, 4] = 2.0
    df = movie.from_array(spark, m).filter("not (y = 5 and x in (2, 3) and t > 4) and not (y = 8 and x = 8)")
    plain = {(q.y, q.x): q.v for q in projections.local_correlation_by_expression(df).collect()}
    got = {(q.y, q.x): q.v for q in projections.local_correlation(df).collect()}
    assert got.keys() == plain.keys() and all(abs(got[k] - plain[k]) < 1e-9 for k in plain)
    for space in (2, 3, 5):
        lo = space // 2
        padded = np.pad(m, [(lo, space - 1 - lo)] * 2 + [(0, 0)], mode="edge")
        want = np.sort(np.stack([padded[i : i + 11, j : j + 9] for i in range(space) for j in range(space)]), 0)[space * space // 2]
        assert np.array_equal(movie.to_array(denoise.median(movie.from_array(spark, m), space, 1)), want)


def test_stencil_of_a_volume(spark):
    v = np.random.default_rng(2).normal(size=(4, 5, 6, 12))
    df = movie.from_array(spark, v, movie.VOLUME)
    plain, got = projections.local_correlation_by_expression(df, movie.VOLUME), projections.local_correlation(df, movie.VOLUME)
    assert np.allclose(movie.to_array(got, movie.VOLUME), movie.to_array(plain, movie.VOLUME))


def test_halos_are_a_small_part_of_the_exchange(spark):
    """Of a field of 64 x 64 at most 1.3 samples are sent for each."""
    from lumiframe.operators import stencil

    df = spark.range(64 * 64 * 2).selectExpr("cast(id div 2 div 64 as int) y", "cast(id div 2 % 64 as int) x", "cast(id % 2 as int) t", "1.0D v")
    assert stencil.tiled(df, ("y", "x"), 1).count() <= 1.3 * df.count()


def test_validation_is_saved_and_restored(spark, tmp_path):
    regions = spark.createDataFrame([(0, "m", "accepted", "{}"), (1, "m", "rejected", "{}"), (2, "m", "accepted", "{}")], pipeline.REGION)
    pixels = spark.createDataFrame([(r, 0, r) for r in range(3)], "roi int, y int, x int")
    found = spark.createDataFrame([(0, 0, 3, 9, 1.0), (0, 1, 12, 14, None), (1, 0, 1, 2, -1.0), (9, 0, 1, 2, 1.0)], "roi int, trans int, t0 int, t1 int, class double")
    s = pipeline.Session(spark).load(movie.from_array(spark, np.zeros((2, 3, 4))), "p").commit_regions(regions, pixels, "Cells")
    s.commit_validation(found, spark.createDataFrame([(0, True), (1, True)], "roi int, artifact boolean")).save(f"{tmp_path}/run")
    back = pipeline.Session.restore(spark, f"{tmp_path}/run")
    assert sorted(map(tuple, back.transients.select("roi", "trans", "t0", "t1", "class").collect()), key=str) == [(0, 0, 3, 9, 1.0), (0, 1, 12, 14, None)]
    assert sorted(map(tuple, back.artifacts.collect())) == [(0, True), (2, False)]
    assert pipeline.Session(spark).load(back.pixels).transients is None and back.clear_regions().artifacts is None


def test_traces_of_unlike_length_are_denoised_in_one_batch(spark, monkeypatch):
    monkeypatch.setattr(denoise, "TOGETHER", 100)
    rows = [(k, 0, t, float((k * 7 + t * t) % 11)) for k in range(9) for t in range(40 if k % 3 else 25)]
    got = denoise.wavelet_time(spark.createDataFrame(rows, movie.MOVIE).coalesce(1)).toPandas()
    for k, p in got.groupby("y"):
        trace = np.array([r[3] for r in rows if r[0] == k])
        assert np.allclose(p.sort_values("t").v, denoise.denoise_line(trace))
