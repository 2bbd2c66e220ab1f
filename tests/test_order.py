import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import linalg, order


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(v)) for k, n in (("a", 3000), ("b", 1), ("c", 7), (None, 40)) for v in np.round(rng.normal(0, 2, n), 1)]
    rows += [("a", 0.5)] * 2000 + [("a", None), ("d", None)]  # a third of all rows share one value
    return rows, spark.createDataFrame(rows, "k string, v double").repartition(6)


def test_quantiles_equal_numpy_over_any_ranges(values):
    rows, df = values
    at = [0.0, 0.01, 0.25, 0.5, 0.999, 1.0]
    for size in (50, 1 << 20):
        got = {r.k: r.quantiles for r in order.exact_quantiles(df, ["k"], "v", at, size).collect()}
        assert set(got) == {"a", "b", "c", None}
        for k, q in got.items():
            assert np.allclose(q, np.quantile([v for n, v in rows if n == k and v is not None], at), atol=1e-12)
    assert order.exact_quantiles(df.where("false"), ["k"], "v", at).collect() == []


def test_quantiles_of_a_key_lie_in_many_tasks(spark):
    df = spark.range(200_000).select(F.lit("one").alias("k"), F.rand(4).alias("v"))
    placed = order.numbered(df, ["k"], [F.col("v")], "i", range_rows=10_000)
    assert placed.agg(F.count_distinct("i").alias("n"), F.max("i").alias("m")).first()[:] == (200_000, 199_999)
    sizes = [r["count"] for r in placed.select(F.floor(F.col("i") / 10_000).alias("r"), "v").groupBy("r").count().collect()]
    assert max(sizes) == 10_000
    laid = [len(p) for p in df.repartitionByRange(order._ranges(df, 10_000), "k", "v").rdd.glom().collect()]
    assert max(laid) < 20_000


@pytest.mark.parametrize("block", [8, 64, 4096])
def test_lag_products_and_times_equal_plain_sums(spark, block):
    rng = np.random.default_rng(7)
    series = {"a": np.convolve(rng.normal(size=330), np.ones(9), "valid"), "b": rng.normal(size=5), "c": np.ones(30)}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "k string, i long, v double").repartition(5)
    most = 12
    got = {(r.k, r.lag): (r.n, r.total) for r in order.lag_products(df, ["k"], "i", "v", most, block).collect()}
    want = {(k, m): (len(x) - m, float((x[: len(x) - m] * x[m:]).sum())) for k, x in series.items() for m in range(min(most, len(x) - 1) + 1)}
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1], abs_tol=1e-8) for k in want)
    acf = order.autocorrelation(df, ["k"], "i", "v", most, block)
    times = {r.k: (r.tau, r.lags) for r in order.integrated_times(acf, ["k"], 2.0).collect()}
    x = series["a"] - series["a"].mean()
    c = np.array([(x[: len(x) - m] * x[m:]).mean() for m in range(most + 1)]) / (x * x).mean()
    stop = next((m for m in range(1, most + 1) if c[m] <= 0), most + 1)
    assert times["a"][1] == stop - 1 and math.isclose(times["a"][0], 2.0 * (0.5 + c[1:stop].sum()), rel_tol=1e-9)


def test_projections_are_the_fitted_frames_along_their_modes(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(0, 4, (7, 3))
    x = base + rng.normal(0, 0.3, (60, 7, 3))
    df = spark.createDataFrame([("t", i, f.ravel().tolist()) for i, f in enumerate(x)], "traj_id string, frame int, xyz array<double>").repartition(4)
    rows = linalg.projections(df, {"t": base}, 4).collect()
    got = np.zeros((60, 4))
    for r in rows:
        got[r.frame, r.mode] = r.value
    fitted = linalg.fit_iteratively(x, base).reshape(60, -1)
    values = np.linalg.eigvalsh(np.cov(fitted.T, bias=True))[::-1][:4]
    assert len(rows) == 240 and np.allclose(got.var(axis=0), values, rtol=1e-6) and np.allclose(got.mean(axis=0), 0, atol=1e-9)


def test_work_tables_are_deleted_on_demand(spark):
    from framewright.functions import work

    table = work.written(spark.range(5), "cleaned")
    assert table.count() == 5 and work.clean(spark) >= 1 and work.clean(spark) == 0
    with pytest.raises(Exception, match="(?i)exist|found"):
        spark.read.parquet(work.shared_dir(spark) + "/framewright-cleaned-*").count()
