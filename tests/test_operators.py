import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import scalars as fn
from framewright.operators import controls, linalg, nulls, relational, series
from tests.synthetic import chain, waters


def turned(x, rng):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    return x @ q + rng.normal(size=3) * 5


def one_fit(mobile, target):
    """Rotation by the eigenvector of the quaternion matrix, an independent way to the same fit."""
    p, q = mobile - mobile.mean(0), target - target.mean(0)
    s = p.T @ q
    k = np.array([[s[0, 0] + s[1, 1] + s[2, 2], s[1, 2] - s[2, 1], s[2, 0] - s[0, 2], s[0, 1] - s[1, 0]], [0, s[0, 0] - s[1, 1] - s[2, 2], s[0, 1] + s[1, 0], s[2, 0] + s[0, 2]], [0, 0, -s[0, 0] + s[1, 1] - s[2, 2], s[1, 2] + s[2, 1]], [0, 0, 0, -s[0, 0] - s[1, 1] + s[2, 2]]])
    k = k + np.triu(k, 1).T
    w, x, y, z = np.linalg.eigh(k)[1][:, -1]
    r = np.array([[w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z]])
    return p @ r.T


def test_fit_equals_quaternion_fit_and_never_reflects():
    rng = np.random.default_rng(0)
    target = chain(5, rng)
    frames = np.stack([turned(target + rng.normal(0, 0.4, target.shape), rng) for _ in range(6)])
    got = linalg.fit(frames, target)
    for f, g in zip(frames, got, strict=True):
        assert np.allclose(g, one_fit(f, target), atol=1e-8)
    mirrored = target * [1, 1, -1]
    assert not np.allclose(linalg.fit(mirrored[None], target)[0], target - target.mean(0), atol=0.1)


def made_frames(spark, rng, n=60, m=5):
    base = chain(m, rng)
    x = np.stack([turned(base + rng.normal(0, 0.3, base.shape), rng) for _ in range(n)])
    df = spark.createDataFrame([("t", i, v.ravel().tolist()) for i, v in enumerate(x)], "traj_id string, frame int, xyz array<double>")
    return base, x, df


def test_subspaces_whole_and_distributed_agree(spark):
    rng = np.random.default_rng(1)
    base, x, df = made_frames(spark, rng)
    whole = linalg.essential_subspaces(df, {"t": base})
    spread = linalg.essential_subspaces(df.repartition(7), {"t": base}, whole=10)
    a, b = (d.orderBy("mode").collect() for d in (whole, spread))
    assert np.allclose([r.eigenvalue for r in a], [r.eigenvalue for r in b], atol=1e-10) and len(a) == base.size
    u, v = linalg.frame_of(whole, "t"), linalg.frame_of(spread, "t")
    assert math.isclose(linalg.rmsip(u, v), 1.0, abs_tol=1e-9)
    fitted = linalg.fit_iteratively(x, base).reshape(len(x), -1)
    want = np.linalg.eigvalsh(np.cov(fitted.T, bias=True))[::-1]
    assert np.allclose([r.eigenvalue for r in a], want, atol=1e-10)
    scaled = df.withColumn("xyz", F.transform("xyz", lambda c: c * 1.3))
    w = linalg.frame_of(linalg.essential_subspaces(scaled, {"t": base * 1.3}), "t")
    assert math.isclose(linalg.rmsip(u, w), 1.0, abs_tol=1e-9)
    assert math.isclose(linalg.overlaps(whole, spread).first().rmsip, 1.0, abs_tol=1e-9)


def test_long_trajectories_share_their_passes(spark):
    """Interleaved trajectories of several sizes, more than a task holds sums of, over more tasks than one round adds up."""
    rng = np.random.default_rng(11)
    targets, rows, sizes = {}, [], {}
    for k in range(linalg.HELD + 4):
        name, base = f"t{k}", chain(4 + k % 3, rng)
        targets[name], sizes[name] = base, 8 if k == 0 else 20 + k
        rows += [(name, i, turned(base + rng.normal(0, 0.3, base.shape), rng).ravel().tolist()) for i in range(sizes[name])]
    df = spark.createDataFrame(rows, "traj_id string, frame int, xyz array<double>")
    whole = linalg.essential_subspaces(df, targets).collect()
    for parts in (3, 70):
        spread = linalg.essential_subspaces(df.repartition(parts, F.rand(5)), targets, whole=10).collect()
        key = lambda r: (r.traj_id, r.mode)
        for a, b in zip(sorted(whole, key=key), sorted(spread, key=key), strict=True):
            assert key(a) == key(b) and math.isclose(a.eigenvalue, b.eigenvalue, abs_tol=1e-9)
            if a.vector and a.mode < 3:
                assert math.isclose(abs(np.dot(a.vector, b.vector)), 1.0, abs_tol=1e-6)


def test_covariance_of_frames_and_of_none(spark):
    rng = np.random.default_rng(12)
    _, x, df = made_frames(spark, rng)
    assert np.allclose(linalg.covariance(df.repartition(5)), np.cov(x.reshape(len(x), -1).T, bias=True), atol=1e-10)
    assert linalg.covariance(df.where("false")).size == 0
    fitted, mean = linalg.superposed(df.where("false"), x[0])
    assert fitted.count() == 0 and mean.shape == (0, 3)


def test_overlaps_on_a_column_leave_out_other_pairs(spark):
    rows = [(t, g, m, [float(i == m + shift) for i in range(4)]) for t, g, shift in (("a", "x", 0), ("b", "x", 1), ("c", "y", 0)) for m in range(2)]
    d = spark.createDataFrame(rows, "traj_id string, g string, mode int, vector array<double>")
    got = {(r.left, r.right): r.rmsip for r in linalg.overlaps(d, d, 2, on="g").collect()}
    every = {(r.left, r.right): r.rmsip for r in linalg.overlaps(d, d, 2).collect()}
    assert set(got) == {(a, b) for a in "ab" for b in "ab"} | {("c", "c")}
    assert all(math.isclose(every[k], v) for k, v in got.items()) and math.isclose(got["a", "b"], math.sqrt(0.5)) and math.isclose(every["a", "c"], 1.0)


def test_rmsip_forms_and_basis_invariance():
    rng = np.random.default_rng(2)
    u, v = (np.linalg.qr(rng.normal(size=(30, 4)))[0] for _ in range(2))
    r, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    assert math.isclose(linalg.rmsip(u, v), math.sqrt((linalg.correlations(u, v) ** 2).sum() / 4))
    assert math.isclose(linalg.rmsip(u @ r, v), linalg.rmsip(v, u)) and math.isclose(linalg.rmsip(u, u), 1.0)


def plain_hessian(x, cutoff):
    n = len(x)
    h = np.zeros((n, 3, n, 3))
    for i in range(n):
        for j in range(n):
            d = x[j] - x[i]
            s = d @ d
            if 0 < s <= cutoff**2:
                h[i, :, j] -= np.outer(d, d) / s
                h[i, :, i] += np.outer(d, d) / s
    return h.reshape(3 * n, 3 * n)


def test_network_hessian_and_sweep(spark):
    rng = np.random.default_rng(3)
    x = chain(6, rng)
    x[3] = x[2]  # coincident sites do not touch
    assert np.allclose(nulls.hessian(x, 7.0), plain_hessian(x, 7.0))
    y = chain(6, rng)
    assert (np.abs(np.linalg.eigvalsh(nulls.hessian(y, 9.0))) < 1e-9).sum() == 6
    far = np.concatenate([y, y + 500])
    assert nulls.network_components(far, 9.0) == 2 and nulls.network_components(y, 9.0) == 1
    assert (np.abs(np.linalg.eigvalsh(nulls.hessian(far, 9.0))) < 1e-9).sum() == 12
    ref = np.linalg.qr(rng.normal(size=(54, 10)))[0]
    null = nulls.network_null(spark, {"s": (y, ref)}).cache()
    got = {r.cutoff: r.rmsip for r in null.collect()}
    assert len(got) == 27 and max(got) == 20.0 and min(got) == 7.0
    assert math.isclose(got[9.0], linalg.rmsip(nulls.network_modes(y, 9.0), ref))
    floor = nulls.null_floor(null).first()
    assert floor.floor == max(got.values()) and got[floor.best_cutoff] == floor.floor


def test_random_null_streams(spark):
    serial = nulls.random_null(spark, 20, 3, 40, seed=5, block=None).orderBy("draw").collect()
    want = list(nulls.random_draws(20, 3, 40, np.random.default_rng(5)))
    assert np.allclose([r.correlations for r in serial], want)
    blocks = nulls.random_null(spark, 189, 10, 1000).agg(F.avg("rmsip"), F.count_distinct("rmsip")).first()
    assert abs(blocks[0] - math.sqrt(10 / 189)) < 0.003 and blocks[1] == 1000


def test_verdicts_at_the_boundary(spark):
    null = spark.createDataFrame([(0.2,), (0.4,)], "rmsip double")
    for x, rejected, p in ((0.4, False, 2 / 3), (0.41, True, 1 / 3)):
        r = nulls.compared(null, spark.createDataFrame([(x,)], "observed double"), []).first()
        assert r.h0_rejected is rejected and math.isclose(r.p_value_upper_bound, p) and math.isclose(r.null_sd, 0.1)
    flat = nulls.compared(null.limit(1), spark.createDataFrame([(0.5,)], "observed double"), []).first()
    assert flat.z_score is None and flat.h0_rejected


def test_unrelated_uses_its_own_id(spark):
    rng = np.random.default_rng(4)
    u, v = (np.linalg.qr(rng.normal(size=(60, 5)))[0] for _ in range(2))
    got = nulls.test_unrelated(spark, u, v, draws=500)
    assert got["test_id"] == nulls.LEGACY_TEST_ID and got["modes_above_null_99"] == 0
    assert nulls.test_unrelated(spark, u, u, draws=500)["h0_rejected"]


def test_contacts_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.random((40, 3)) * 10, [[1, 1, 1], [1, 1, 1], [1, 1, 4]]])
    df = spark.createDataFrame([("s", i, *map(float, p)) for i, p in enumerate(x)], "structure string, site int, x double, y double, z double")
    got = {(r.site, r.other) for r in nulls.contacts(df, 3.0).collect()}
    d = np.square(x[:, None] - x[None]).sum(-1)
    assert got == {(i, j) for i in range(len(x)) for j in range(len(x)) if 0 < d[i, j] <= 9.0}
    assert (40, 42) in got and (40, 41) not in got


def test_contact_counts_and_site_hessians_by_blocks_equal_all_pairs(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 2, (150, 3)), [[1, 1, 1]] * 5, [[1, 1, 4], [0.0, 0, 0], [-0.0, 0, 0]]])
    odd = [("s", 900, 1.0, None, 1.0), ("s", 901, math.nan, 1.0, 1.0), ("s", 902, math.inf, 1.0, 1.0), (None, 903, 1.0, 1.0, 1.1)]
    rows = [("s", i, *map(float, p)) for i, p in enumerate(x)] + [("t", i, *map(float, p)) for i, p in enumerate(x[:3] * 50)] + odd
    df = spark.createDataFrame(rows, "structure string, site int, x double, y double, z double")
    square = np.square(x[:, None] - x[None]).sum(-1)
    cutoffs = [0.5, 3.0, 1.25]
    got = {(r.structure, r.cutoff): r.contacts for r in nulls.contact_counts(df, cutoffs, most=16).collect()}
    assert got == {("s", c): int(((square > 0) & (square <= c * c)).sum()) for c in cutoffs}
    assert got == {(r.structure, r.cutoff): r.contacts for r in nulls.contact_counts(df, cutoffs).collect()}
    own = nulls.hessian(x, 3.0).reshape(len(x), 3, len(x), 3)
    for most in (16, nulls.SITES):
        sums = {(r.structure, r.site): [r[f"h{c}"] for c in nulls.AXES] for r in nulls.site_hessians(df, 3.0, most).collect()}
        touching = ((square > 0) & (square <= 9)).any(axis=1)
        assert set(sums) == {("s", int(i)) for i in np.flatnonzero(touching)}
        assert all(np.allclose(sums["s", i], own[i, :, i][np.triu_indices(3)], atol=1e-9) for i in np.flatnonzero(touching).tolist())


def test_contact_sweep_moves_blocks_not_pairs(spark, tmp_path):
    """3,000 sites of one label have millions of pairs; two rows go out for each pair of blocks in reach, one for a block with itself."""
    from framewright.plans import queries

    x = np.random.default_rng(7).normal(0, 0.12, (3000, 3)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["contact_sweep"](spark, str(tmp_path))
    wide = x.astype(np.float64)
    square = np.square(wide[:, None] - wide[None]).sum(-1)
    assert {r.cutoff: r.contacts for r in got.collect()} == {c: int(((square > 0) & (square <= c**2)).sum()) for c in (round(0.05 + 0.01 * k, 2) for k in range(27))}
    sites = spark.createDataFrame([("s", i, *map(float, v)) for i, v in enumerate(wide)], "structure string, site int, x double, y double, z double")
    blocks = nulls.site_blocks(sites, 0.31)
    cells = np.array([(r.cx, r.cy, r.cz) for r in blocks.collect()])
    near = (np.abs(cells[:, None] - cells[None]).max(axis=-1) <= 1).sum()
    assert blocks.select(F.sum(F.size("x"))).first()[0] == 3000 and nulls.block_pairs(blocks).count() == near


def test_a_range_of_the_clock_holds_little_however_many_ranges_need_it():
    import tracemalloc

    import pyarrow as pa

    frames, width = series.RANGE, min(series.BLOCK, 100)
    xyz = pa.FixedSizeListArray.from_arrays(pa.array(np.random.default_rng(9).normal(0, 1, frames * width * 3)), width * 3).cast(pa.list_(pa.float64()))
    part = pa.table({"frame": np.arange(frames), "box": np.full(frames, 50.0), "at": pa.nulls(frames, pa.list_(pa.int32())), "xyz": xyz, "width": pa.array([width] * frames, pa.int32())})
    carry = {"traj_id": "t", "b": 0, "part": 90, "g": 90 * frames, "n_frames": 100 * frames, "start": np.zeros((width, 3)).tobytes(), "closing": np.zeros(width, dtype=bool).tobytes(), "needs": list(range(11, 91))}
    tracemalloc.start()
    got = series._walked(part, pa.Table.from_pylist([carry]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20 and got.nbytes < 64 << 20


def frame_rows(spark, x, box, dt=1.0):
    rows = [("t", k, k * dt, box, v.ravel().tolist()) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "traj_id string, frame int, time_ps double, box double, tracer_nm array<float>")


def plain_clock(x, box, dt):
    step = np.diff(x, axis=0)
    walk = np.cumsum(step - box * np.round(step / box), axis=0)
    h = max(2, (len(x) - 1) // 5)
    lags = np.unique(np.linspace(1, h, min(40, h)).astype(int))
    msd = [np.square(walk[k:] - walk[:-k]).sum(-1).mean() for k in lags]
    return np.square(walk[-1]).sum(-1).mean(), np.polyfit(lags * dt, msd, 1)[0]


def test_clock_recovers_elapsed_time(spark):
    rng = np.random.default_rng(6)
    x = waters(400, 300, 3.0, 0.003, rng, 2.0).astype(np.float32)
    r = series.clocks(frame_rows(spark, x, 3.0, 2.0)).first()
    total, slope = plain_clock(x.astype(np.float64), 3.0, 2.0)
    assert math.isclose(r.total_msd_nm2, total, rel_tol=1e-6) and math.isclose(r.elapsed_ps, total / slope, rel_tol=1e-6)
    assert 500 < r.elapsed_ps < 1200 and r.frame_interval_ps == 2.0 and r.n_tracers == 300
    long = frame_rows(spark, x, 3.0, 2.0).select("traj_id", "frame", "box", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: F.struct(*[F.col("tracer_nm")[i * 3 + k].cast("double").alias(a) for k, a in enumerate("xyz")]))).alias("tracer", "p")).select("traj_id", "frame", "box", "tracer", "p.*")
    msd = joined_msd(long)
    for length, feed in ((series.RANGE, series.dealt_positions(long)), (64, series.dealt_frames(frame_rows(spark, x, 3.0, 2.0)))):
        sums = {m.lag: m.msd for m in series.msd_of(series.lag_sums(feed, length=length)).collect()}
        assert set(msd) == set(sums) - {0} and all(math.isclose(msd[k], sums[k], rel_tol=1e-6) for k in msd)
        assert math.isclose(sums[0], total, rel_tol=1e-6)


def joined_msd(positions):
    """lag: msd by joining the windowed walk with itself."""
    walk = series.walks(positions).cache()
    n = walk.select("frame").distinct().count() + 1
    out = {}
    for k in series.lags_for(n):
        late = walk.select("tracer", (F.col("frame") - k).alias("frame"), *[F.col(f"w{a}").alias(f"l{a}") for a in "xyz"])
        out[k] = walk.join(late, ["tracer", "frame"]).agg(F.avg(sum((F.col(f"w{a}") - F.col(f"l{a}")) ** 2 for a in "xyz"))).first()[0]
    return out


@pytest.mark.parametrize("length", [7, 16, 50, 1000])
def test_ranges_of_any_length_give_the_same_sums(spark, length):
    rng = np.random.default_rng(13)
    rows = []
    for traj, n, tracers in (("a", 90, 70), ("b", 41, 3), ("c", 2, 2), ("d", 1, 2)):
        for k in range(tracers):
            stops = n - int(rng.integers(0, n // 2 + 1)) * (k % 3 == 0)  # some leave early
            x = np.cumsum(rng.normal(0, 2.5, (n, 3)), axis=0) % 10
            rows += [(traj, f"w{k}", f, 10.0, *map(float, x[f])) for f in range(stops)]
    df = spark.createDataFrame(rows, "traj_id string, tracer string, frame int, box double, x double, y double, z double").repartition(5)
    want = {(r.traj_id, r.lag): (r.n, r.total) for r in series.lag_sums(series.dealt_positions(df)).groupBy("traj_id", "lag").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
    got = {(r.traj_id, r.lag): (r.n, r.total) for r in series.lag_sums(series.dealt_positions(df), length=length).groupBy("traj_id", "lag").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
    assert set(want) == set(got) and {k[0] for k in want} >= {"a", "b"}
    assert all(want[k][0] == got[k][0] and math.isclose(want[k][1], got[k][1], rel_tol=1e-9) for k in want)
    alone = joined_msd(df.where("traj_id = 'a'"))
    assert all(math.isclose(got["a", k][1] / got["a", k][0], v, rel_tol=1e-9) for k, v in alone.items())


@pytest.mark.parametrize(("frames", "tracers", "reason"), [(10, 99, "only 99 solvent atoms"), (4, 100, "only 4 frames"), (4, 99, "only 99 solvent atoms"), (5, 100, None), (3, 0, "only 0 solvent atoms")])
def test_clock_guards(spark, frames, tracers, reason):
    x = waters(frames, tracers, 3.0, 0.003, np.random.default_rng(7)).astype(np.float32) if tracers else np.zeros((frames, 0, 3))
    r = series.clocks(frame_rows(spark, x, 3.0)).first()
    assert r.reason == reason and r.measurable == (reason is None)


def test_half_box_steps_round_to_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "d double")
    assert [r[0] for r in df.select(fn.minimum_image(F.col("d"), F.lit(1.0))).collect()] == [0.5, -0.5, 0.5, -0.5]


def test_tracer_choice():
    assert series.sample_tracers(list(range(900))) == list(range(900))
    got = series.sample_tracers(list(range(5000)))
    assert len(got) == 1000 and got == sorted(np.random.default_rng(20260819).choice(5000, 1000, replace=False).tolist())


def test_gyration_forms_agree(spark):
    from framewright.sources.frames import long_frames

    x = np.random.default_rng(8).normal(size=(5, 9, 3))
    df = spark.createDataFrame([("t", i, v.ravel().tolist()) for i, v in enumerate(x)], "traj_id string, frame int, protein_nm array<double>")
    a = {r.frame: r.rg for r in series.radii_of_gyration(df).collect()}
    b = {r.frame: r.rg for r in series.radii_of_gyration_long(long_frames(df, "protein_nm")).collect()}
    for k in a:
        assert math.isclose(a[k], b[k]) and math.isclose(a[k], math.sqrt(np.square(x[k] - x[k].mean(0)).sum(1).mean()))


def test_predicate_bounds(spark):
    row = spark.createDataFrame([(1.0, None)], "x double, n double")
    x, n = F.col("x"), F.col("n")
    got = row.select(fn.band(x, 1, 2), fn.band(x, 0, 1), fn.band(n, 0, 1), fn.within(x, 2, 1), fn.within(x, 2.01, 1), fn.within(n, 2, 1), fn.relative_within(x, F.lit(0.0), 0.1), fn.folded_contains(F.lit(None).cast("string"), F.lit("a"))).first()
    assert tuple(got) == (True, True, False, True, False, False, False, False)


def test_first_wins_last_wins_and_pairs(spark):
    atoms = spark.createDataFrame([(0, "A", "1", "SG", 0.0, 0.0, 0.0), (1, "B", "1", "SG", 5.0, 0.0, 0.0), (2, "A", "2", "SG", 5.0, 2.5, 0.0), (3, "A", "3", "SG", 5.0, 2.51, 0.0)], "ordinal int, chain string, resid string, atom_name string, x double, y double, z double")
    contract = spark.createDataFrame([(0, "1", "SG"), (1, "9", "SG")], "k int, resid string, atom_name string")
    assert [(r.k, r.own_ordinal) for r in relational.resolve_contract(contract, atoms).orderBy("k").collect()] == [(0, 0), (1, None)]
    assert relational.missing_contract(contract, atoms).first().k == 1
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 9)], "a int, b int")
    got = {r.b: r.distance for r in relational.broken_pairs(atoms, pairs, F.lit(2.5)).collect()}
    assert set(got) == {"3", "9"} and got["9"] is None and math.isclose(got["3"], 2.51)


def test_rollup_weights_and_defaults(spark):
    rows = spark.createDataFrame([("a", True, 1.0), ("b", False, 0.5), ("c", True, 1.0)], "check_id string, passed boolean, weight double")
    cats = spark.createDataFrame([("a", "md"), ("b", "md")], "check_id string, category string")
    got = {r.category: (r.passed, r.total, r.weight, r.passed_weight) for r in relational.category_rollup(relational.with_category(rows, cats)).collect()}
    assert got == {"md": (1, 2, 1.5, 1.0), "prep": (1, 1, 1.0, 1.0), None: (2, 3, 2.5, 2.0)}
    with pytest.raises(KeyError):
        relational.parameter(cats, "z", "category", required=True)
    assert relational.parameter(cats, "z", "category") is None and relational.parameter(cats, "a", "category").category == "md"
    assert not relational.all_true(rows, "passed") and relational.all_true(rows.limit(0), "passed")


def test_sets(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "x int") for v in ([1, 2], [2, 1]))
    assert relational.same_sets(a, b) and not relational.same_sets(a, b.limit(1))
    assert relational.pooled(p=a, q=b).groupBy("replica_id").count().count() == 2


def test_synthetic_baselines():
    x = chain(6, np.random.default_rng(9))
    made = controls.synthetic_baselines(x)
    assert list(made) == ["anm_ensemble", "isotropic_noise", "duplicated_minimum"] and all(v.shape == (500, 18, 3) for v in made.values())
    first = np.linalg.eigh(nulls.hessian(x, 10.0))[1][:, 6]
    spread = ((made["anm_ensemble"] - x).reshape(500, -1) @ first).std()
    assert 1.35 < spread < 1.65
    assert abs((made["isotropic_noise"] - x).std() - 0.5) < 0.01 and (made["duplicated_minimum"] - x).std() < 2e-4


def test_containing_and_first_of(spark):
    from framewright.operators import relational

    docs = spark.createDataFrame([(1, "Ab bc CD"), (2, None), (3, ""), (4, "xbcx abcd"), (4, "xbcx abcd")], "doc_id int, text string")
    tokens = spark.createDataFrame([("p", "BC"), ("q", "ab"), ("r", "ab"), ("s", None), ("t", "zz"), ("u", "xbcx abcd!")], "name string, token string")
    want = [(1, "p"), (1, "q"), (1, "r"), *[(4, x) for x in "ppqqrr"]]
    for n in (8_000_000, 4):
        assert sorted(map(tuple, relational.containing(docs, tokens, "name", max_chars=n).collect())) == want
    assert relational.containing(docs, spark.createDataFrame([("e", "")], tokens.schema), "name").count() == 4
    assert relational.containing(docs, tokens.limit(0), "name").collect() == relational.containing(docs.limit(0), tokens, "name").collect() == []
    rows = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 5)], "k string, v int")
    assert sorted((r.k, r.v, r["rank"]) for r in relational.first_of(rows, ["k"], [F.col("v")], 1, 1).collect()) == [("a", 2, 1)]


def test_block_bootstrap_keeps_the_mean_and_narrows_with_the_series(spark):
    from framewright.plans import catalog

    rows = spark.range(4000).select("id", F.sin(F.col("id") * 0.7).alias("v"))
    mean = rows.agg(F.avg("v")).first()[0]
    got = catalog.block_bootstrap(rows, "id", "v", 50, 200, 7)
    means = [r[got.columns[-1]] for r in got.collect()]
    assert len(means) == 200 and abs(np.mean(means) - mean) < 0.01 and 0 < np.std(means) < 0.05
    assert sorted(means) == sorted(r[got.columns[-1]] for r in catalog.block_bootstrap(rows, "id", "v", 50, 200, 7).collect())


def test_window_subspaces_of_a_steady_motion_agree_with_the_whole(spark):
    from framewright.operators import linalg

    rng = np.random.default_rng(2)
    coords = rng.normal(0, 8, (12, 3))
    basis, _ = np.linalg.qr(rng.normal(0, 1, (36, 10)))
    xyz = coords.ravel() + (rng.normal(0, 1, (120, 10)) * np.linspace(3, 1, 10)) @ basis.T
    frames = spark.createDataFrame([("t", k, x.tolist()) for k, x in enumerate(xyz)], "traj_id string, frame int, xyz array<double>")
    got = linalg.window_subspaces(frames, {"t": coords}, 40).cache()
    assert {r.traj_id for r in got.select("traj_id").distinct().collect()} == {"t#0", "t#1", "t#2"}
    alone = linalg.essential_subspaces(frames.where("frame between 40 and 79"), {"t": coords})
    whole = linalg.essential_subspaces(frames, {"t": coords})
    mine = linalg.frame_of(got, "t#1")
    assert abs(linalg.rmsip(mine, linalg.frame_of(alone, "t")) - 1) < 1e-6
    assert 0.9 < linalg.rmsip(mine, linalg.frame_of(whole, "t")) <= 1 + 1e-9


def test_sliding_windows_equal_each_windows_own_moments(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(0, 5, (6, 3))
    frames = {f"t{k}": base + rng.normal(0, 0.4, (47, 6, 3)) for k in range(3)}
    rows = [(t, i, f.ravel().tolist()) for t, x in frames.items() for i, f in enumerate(x)]
    df = spark.createDataFrame(rows, "traj_id string, frame int, xyz array<double>").repartition(5)
    got = {}
    for r in linalg.sliding_subspaces(df, dict.fromkeys(frames, base), 20, 5, 4).collect():
        got.setdefault(r.traj_id, {})[r["mode"]] = (r.eigenvalue, r.vector)
    assert set(got) == {f"{t}#{s}" for t in frames for s in range(0, 26, 5)}
    for name, modes in got.items():
        t, s = name.split("#")
        fitted = linalg.fit_iteratively(frames[t], base).reshape(47, -1)[int(s) : int(s) + 20]
        values, vectors = linalg.modes_of(np.cov(fitted.T, bias=True), 4)
        assert np.allclose([modes[i][0] for i in range(18)], values, atol=1e-9)
        assert math.isclose(linalg.rmsip(np.array([modes[i][1] for i in range(4)]).T, vectors), 1.0, abs_tol=1e-9)


def test_sliding_windows_across_ranges_and_gaps_move_frames_not_matrices(spark, monkeypatch):
    rng = np.random.default_rng(10)
    base = rng.normal(0, 5, (6, 3))
    x = base + rng.normal(0, 0.4, (420, 6, 3))
    there = [i for i in range(420) if i not in (200, 333, 334)]
    df = spark.createDataFrame([("t#1", i, x[i].ravel().tolist()) for i in there], "traj_id string, frame int, xyz array<double>").repartition(7)
    fitted = dict(zip(there, linalg.fit_iteratively(x[there], base).reshape(len(there), -1), strict=True))
    monkeypatch.setattr(linalg, "RANGE_BLOCKS", 8)
    totals, seen = linalg._totals, []
    monkeypatch.setattr(linalg, "_totals", lambda partials, finish, schema: seen.append(schema) or totals(partials, finish, schema))
    got = {}
    for r in linalg.sliding_subspaces(df, {"t#1": base}, 20, 5, 4).collect():
        assert got.setdefault(r.traj_id, {}).setdefault(r["mode"], r.eigenvalue) == r.eigenvalue
    assert set(seen) == {linalg._AIMS}  # only mean structures are summed across tasks
    assert set(got) == {f"t#1#{s}" for s in range(0, 401, 5) if all(i in fitted for i in range(s, s + 20))}
    for name, modes in got.items():
        s = int(name.split("#")[-1])
        values = linalg.modes_of(np.cov(np.array([fitted[i] for i in range(s, s + 20)]).T, bias=True), 4)[0]
        assert np.allclose([modes[i] for i in range(18)], values, atol=1e-9)


def test_subspaces_of_20000_structures_pass_through_no_driver(spark):
    n = 20_000
    x = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.sin(F.col("t") * 0.37 + i * 1.7) * 5 + F.sin(F.col("f") * (i + 2) * 1.3 + F.col("t")) * 0.2)
    frames = spark.range(n * 3).select(F.floor(F.col("id") / 3).alias("t"), (F.col("id") % 3).cast("int").alias("f")).select(F.col("t").cast("string").alias("traj_id"), F.col("f").alias("frame"), x.alias("xyz"))
    aims = frames.where("frame = 0").select("traj_id", F.col("xyz").alias("aim"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spaces = linalg.essential_subspaces(frames, aims, 2)
        plan = spaces._jdf.queryExecution().toString()
        assert "FlatMapCoGroupsInPandas" in plan and "Broadcast" not in plan
        row = spaces.agg(F.count("*").alias("rows"), F.count_distinct("traj_id").alias("trajectories")).first()
        assert (row.rows, row.trajectories) == (9 * n, n)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_trajectory_without_a_structure_raises(spark):
    df = spark.createDataFrame([("a", 0, [0.0] * 9), ("b", 0, [1.0] * 9)], "traj_id string, frame int, xyz array<double>")
    with pytest.raises(Exception, match="no structure"):
        linalg.essential_subspaces(df, {"a": np.zeros((3, 3))}, 1).collect()


def test_overlaps_in_blocks_of_references(spark, monkeypatch):
    rng = np.random.default_rng(4)
    frames = {f"s{k}": np.linalg.qr(rng.normal(size=(12, 3)))[0] for k in range(7)}
    df = spark.createDataFrame([(k, i, v[:, i].tolist()) for k, v in frames.items() for i in range(3)], "traj_id string, mode int, vector array<double>")
    monkeypatch.setattr(linalg, "REFERENCE_BYTES", 700)
    got = {(r.left, r.right): r.rmsip for r in linalg.overlaps(df, df.where("traj_id < 's5'"), 3).collect()}
    assert set(got) == {(a, b) for a in frames for b in frames if b < "s5"}
    assert all(math.isclose(x, linalg.rmsip(frames[a], frames[b]), abs_tol=1e-12) for (a, b), x in got.items())


def helix(n, rng):
    """A compact chain of n sites."""
    i = np.arange(n)
    radius = 4.0 * np.cbrt(i + 8.0) / 2
    return np.stack([radius * np.cos(i * 2.4), radius * np.sin(i * 2.4), radius * np.cos(i * 0.7)], axis=1) * 1.2 + rng.normal(0, 0.6, (n, 3))


def test_sparse_network_equals_the_dense_one():
    rng = np.random.default_rng(11)
    x = helix(228, rng)
    for cutoff in (9.0, 13.0, 20.0):
        assert nulls.network_components(x, cutoff) == 1
        i, j = nulls.touching(x, cutoff)
        square = np.square(x[:, None] - x[None]).sum(axis=-1)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a in range(228) for b in range(a + 1, 228) if 0 < square[a, b] <= cutoff**2}
        dense = nulls.network_modes(x, cutoff)
        sparse = nulls.sparse_modes(x, cutoff)
        assert abs(linalg.rmsip(dense, sparse) - 1) < 1e-8
        assert np.abs(np.abs(dense.T @ sparse) - np.eye(10)).max() < 1e-6
        net, h, v = nulls.SparseNetwork(x, cutoff), nulls.hessian(x, cutoff), rng.normal(size=(684, 2))
        assert np.allclose(net.times(v), h @ v) and np.allclose(h @ net.solve(v) + net.shift * net.solve(v), v, atol=1e-8)
    far = np.concatenate([x[:20], x[:20] + 500])
    assert nulls.network_components(far, 25.0) == 2


def test_network_of_5000_sites_in_bounded_memory():
    import subprocess
    import sys

    code = """
import resource, numpy as np
from framewright.operators import nulls
from tests.test_operators import helix
x = helix(5000, np.random.default_rng(2))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
modes = nulls.sparse_modes(x, 10.0)
net = nulls.SparseNetwork(x, 10.0)
image = net.times(modes)
values = (modes * image).sum(axis=0)
assert np.abs(image - modes * values).max() < 1e-7 and (values > 1e-6).all() and (np.diff(values) > -1e-9).all()
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600, check=True)
    assert int(got.stdout) < 1200  # one dense Hessian is 1,717 MB, its spectrum twice that
