"""Analytics over a catalogue of projects: eligibility, axes, histograms, agreement measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.scalars import is_licensed
from framewright.operators import order


def eligible(projects: DataFrame, licence: str, method: Column, analyses: Column, entry: Column) -> DataFrame:
    """Projects with an open licence, the right method, a full set of analyses and a structure entry."""
    return projects.where(is_licensed(F.col(licence)) & F.coalesce(method & analyses & entry, F.lit(False)))


def by_axis(projects: DataFrame, **axes: Column) -> DataFrame:
    """axis, projects: how many projects each capability holds; one pass, axes may overlap."""
    row = projects.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in axes.items()])
    return row.unpivot([], list(axes), "axis", "projects")


def histogram(projects: DataFrame, value: Column, name: str) -> DataFrame:
    return projects.groupBy(value.alias(name)).agg(F.count("*").alias("projects"))


def licence_class(licence: Column) -> Column:
    return F.when(licence.rlike("(?i)CC0"), "CC0").when(licence.rlike("(?i)CC BY|Creative Commons"), "CC-BY").otherwise("other")


def by_name_prefix(projects: DataFrame, key: str, names: str, suffix: str = "-[0-9]+$") -> DataFrame:
    """name, projects: distinct projects by analysis name, numbered suffixes folded."""
    return projects.select(key, F.explode(names).alias("n")).select(key, F.regexp_replace("n", suffix, "").alias("name")).groupBy("name").agg(F.count_distinct(key).alias("projects"))


def differing_groups(rows: DataFrame, key: str, value: str, least: int = 2) -> DataFrame:
    """Keys with at least `least` distinct values, and how many."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("values")).where(F.col("values") >= least)


def crosscheck(found: DataFrame, published: DataFrame, mode: str = "mode", value: str = "eigenvalue") -> DataFrame:
    """Smallest and largest relative difference of found from published values, joined by mode."""
    both = found.select(mode, F.col(value).alias("f")).join(published.select(mode, F.col(value).alias("p")), mode)
    return both.agg(F.min(F.try_divide(F.col("f") - F.col("p"), F.col("p"))).alias("least"), F.max(F.try_divide(F.col("f") - F.col("p"), F.col("p"))).alias("most"), F.count("*").alias("modes"))


def profile_correlation(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Pearson and Spearman (average ranks) correlation of two profiles."""
    ranked = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, F.col(a).alias("_a"), F.col(b).alias("_b"))
    for c in ("_a", "_b"):
        values = order.numbered(ranked.groupBy(*keys, c).agg(F.count("*").alias("_n")), keys, [F.col(c)], "_before", "_n")
        rank = values.select(*keys, c, (F.col("_before") + (F.col("_n") + 1) / 2).alias(f"_rank{c}"))
        ranked = ranked.join(rank, [*keys, c])
    return ranked.groupBy(*keys).agg(F.corr(F.col("_a").cast("double"), F.col("_b").cast("double")).alias("pearson"), F.corr("_rank_a", "_rank_b").alias("spearman"))


def wasserstein(rows: DataFrame, keys: list[str], group: Column, value: str, points: int = 101) -> DataFrame:
    """Mean difference of the quantiles of two groups (group: boolean), at evenly spaced points."""
    split = rows.select(*keys, F.col(value).alias("_v"), group.alias("_g")).where(F.col("_g").isNotNull())
    q = order.exact_quantiles(split, [*keys, "_g"], "_v", [i / (points - 1) for i in range(points)])
    a, b = q.where("_g").select(*keys, F.col("quantiles").alias("a")), q.where("NOT _g").select(*keys, F.col("quantiles").alias("b"))
    gap = F.aggregate(F.zip_with("a", "b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / points
    return a.join(b, keys, "full").select(*keys, gap.alias("distance"))


def block_bootstrap(rows: DataFrame, by: str, value: str, width: int, draws: int, seed: int) -> DataFrame:
    """draw, mean: means of resampled blocks of consecutive rows (by // width; a gap in it is an empty block).

    Block sums are formed once; each draw picks as many blocks as there are, by hash.
    """
    blocks = rows.groupBy(F.floor(F.col(by) / width).alias("b")).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    ends = rows.agg(F.floor(F.min(by) / width).alias("first"), F.floor(F.max(by) / width).alias("last")).first()
    if ends.first is None:
        return blocks.select(F.col("b").alias("draw"), F.lit(0.0).alias("mean"))
    total = ends.last - ends.first + 1
    picks = rows.sparkSession.range(draws * total).select(F.floor(F.col("id") / total).alias("draw"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(total)) + ends.first).alias("b"))
    return picks.join(blocks, "b").groupBy("draw").agg((F.sum("s") / F.sum("n")).alias("mean"))


def autocorrelation(series: DataFrame, keys: list[str], by: str, value: str, lags: int) -> DataFrame:
    """keys, lag, acf of the series of each key in the order of `by`."""
    return order.autocorrelation(order.numbered(series.select(*keys, by, value), keys, [F.col(by)], "_i"), keys, "_i", value, lags)
