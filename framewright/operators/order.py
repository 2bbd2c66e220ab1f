"""Order statistics and lag products of long series: ranges of the order are tasks, no key meets in one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.work import written

#: Rows of a range, and the most ranges.
RANGE_ROWS, MAX_RANGES = 1 << 20, 50_000
#: Rows of a block of a series, at least.
BLOCK_ROWS = 4096


def _ranges(rows: DataFrame, range_rows: int) -> int:
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MAX_RANGES, max(least, -(-rows.count() // range_rows)))


def numbered(rows: DataFrame, group: list[str], order: list[Column], out: str, weight: str | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with `out`, how many stand before each in its group by `order` (or how much of column `weight` does).

    Rows are written in sorted ranges of (group, order); a row's place is what the group has in earlier ranges, from
    one row of totals for each range and group, and what stands before it in its own range.
    """
    keys = [*map(F.col, group), *order]
    laid = rows.repartitionByRange(_ranges(rows, range_rows), *keys).sortWithinPartitions(*keys)
    laid = written(laid.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")), "ordered")
    amount = F.col(weight) if weight else F.lit(1)
    totals = laid.groupBy(*group, "_range").agg(F.sum(amount).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*group).orderBy("_range")) - F.col("_sum")
    starts = totals.select(F.struct(*group).alias("_of"), F.col("_range").alias("_part"), before.alias("_before"))
    own = F.sum(amount).over(Window.partitionBy(*group, "_range").orderBy("_at")) - amount
    got = laid.withColumn("_own", own).join(starts, F.struct(*group).eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_part")))
    return got.select(*rows.columns, (F.col("_own") + F.col("_before")).cast("long").alias(out))


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, at: list[float], range_rows: int = RANGE_ROWS) -> DataFrame:
    """keys, quantiles (an array in the order of `at`): linear interpolation between the two nearest ranks, nulls left out.

    Equal values are counted before they are ordered, so a value that a third of the rows share is one row.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    placed = numbered(counted, keys, [F.col("_v")], "_before_v", "_n", range_rows)
    sizes = written(placed.groupBy(*keys).agg(F.max(F.col("_before_v") + F.col("_n")).alias("_size")), "sizes")
    place = F.array(*[F.lit(float(q)) for q in at])
    wanted = F.transform(place, lambda q: q * (F.col("_size") - 1))
    ranks = F.array_distinct(F.flatten(F.transform(wanted, lambda p: F.array(F.floor(p), F.ceil(p)))))
    same = lambda a, b: F.struct(*[F.col(f"{a}.{k}") for k in keys]).eqNullSafe(F.struct(*[F.col(f"{b}.{k}") for k in keys]))
    met = placed.alias("p").join(sizes.withColumn("_ranks", ranks).alias("s"), same("p", "s"))
    hits = met.select(*[F.col(f"p.{k}") for k in keys], "_size", "_v", F.filter("_ranks", lambda r: (r >= F.col("_before_v")) & (r < F.col("_before_v") + F.col("_n"))).alias("_hit")).where(F.size("_hit") > 0)
    # at most two ranks for each quantile of a key
    found = hits.select(*keys, "_size", "_v", F.explode("_hit").alias("_r")).groupBy(*keys, "_size").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_by"))

    def between(p: Column) -> Column:
        low, high = F.element_at("_by", F.floor(p)), F.element_at("_by", F.ceil(p))
        return low + (high - low) * (p - F.floor(p))

    return found.select(*keys, F.transform(F.transform(place, lambda q: q * (F.col("_size") - 1)), between).alias("quantiles"))


def lag_products(series: DataFrame, keys: list[str], at: str, value: str, most: int, block: int = BLOCK_ROWS) -> DataFrame:
    """keys, lag (0 to most), n, total: sums of value[i] * value[i + lag] over each series (at: 0, 1, 2, ...).

    A block of a series takes along the `most` rows after it; its products at all lags come from one Fourier transform.
    """
    block = max(block, most)
    own = F.floor(F.col(at) / block)
    halo = F.when((F.col(at) % block < most) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    rows = series.select(*keys, F.col(at).cast("long").alias("_at"), F.col(value).cast("double").alias("_x"), F.explode(halo).alias("_block"))
    kinds = ", ".join(f"`{k}` {series.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, part: pa.Table) -> pa.Table:
        start = key[-1].as_py() * block
        place = part["_at"].to_numpy() - start
        x = np.zeros(block + most)
        x[place] = part["_x"].to_numpy()
        there = np.zeros(block + most)
        there[place] = 1.0
        size = 1 << int(2 * block + most).bit_length()
        spectrum = lambda v, n: np.fft.rfft(v[:n], size)
        products = np.fft.irfft(np.conj(spectrum(x, block)) * spectrum(x, block + most), size)[: most + 1]
        pairs = np.rint(np.fft.irfft(np.conj(spectrum(there, block)) * spectrum(there, block + most), size)[: most + 1]).astype(np.int64)
        columns = {k: pa.array([key[i].as_py()] * (most + 1), part.schema.field(k).type) for i, k in enumerate(keys)}
        return pa.table({**columns, "lag": pa.array(range(most + 1), pa.int32()), "n": pa.array(pairs), "total": pa.array(products)})

    sums = rows.groupBy(*keys, "_block").applyInArrow(run, f"{kinds}, lag int, n long, total double")
    return sums.groupBy(*keys, "lag").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0")


def autocorrelation(series: DataFrame, keys: list[str], at: str, value: str, most: int, block: int = BLOCK_ROWS) -> DataFrame:
    """keys, lag, acf: mean lag products of the centred series over its population variance (at: 0, 1, 2, ...)."""
    same = lambda a, b: F.struct(*[F.col(f"{a}.{k}") for k in keys]).eqNullSafe(F.struct(*[F.col(f"{b}.{k}") for k in keys]))
    means = written(series.groupBy(*keys).agg(F.avg(value).alias("_mean")), "series-means")
    centred = series.alias("s").join(means.alias("m"), same("s", "m")).select(*[F.col(f"s.{k}") for k in keys], F.col(at), (F.col(value) - F.col("_mean")).alias("_centred"))
    got = written(lag_products(centred, keys, at, "_centred", most, block).select(*keys, "lag", (F.col("total") / F.col("n")).alias("c")), "lag-products")
    zero = got.where("lag = 0").select(*keys, F.col("c").alias("_c0"))
    return got.alias("g").join(zero.alias("z"), same("g", "z")).select(*[F.col(f"g.{k}") for k in keys], "lag", F.try_divide("c", "_c0").alias("acf"))


def integrated_times(acf: DataFrame, keys: list[str], interval: float = 1.0) -> DataFrame:
    """keys, tau, lags: interval * (1/2 + the sum of acf over the lags before it is first zero or less), and how many those are.

    Where the correlation stays positive to the last lag, all lags count and tau is a lower bound.
    """
    # an array of as many entries as there are lags
    row = acf.where("lag > 0").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lag", "acf"))).alias("_c"))
    ends = F.transform(F.filter("_c", lambda c: ~F.coalesce(c["acf"] > 0, F.lit(False))), lambda c: c["lag"])
    lags = F.coalesce(F.array_min(ends) - 1, F.size("_c"))
    total = F.aggregate(F.filter("_c", lambda c: c["lag"] <= F.col("lags")), F.lit(0.0), lambda s, c: s + c["acf"])
    return row.withColumn("lags", lags.cast("int")).select(*keys, ((total + 0.5) * interval).alias("tau"), "lags")
