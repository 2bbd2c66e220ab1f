"""Negative controls: baselines without real dynamics, and their verdicts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .nulls import hessian

#: Name, whether it must pass.
BASELINES = (("real_full_run", True), ("truncated_100ps", False), ("truncated_10ps", False), ("anm_ensemble", False), ("isotropic_noise", False), ("duplicated_minimum", False))
SEED = 11
FRAMES = 500


def network_ensemble(coords: np.ndarray, rng: np.random.Generator, n_frames: int = FRAMES, cutoff: float = 10.0, first: float = 1.5) -> np.ndarray:
    """Gaussian samples along all elastic-network modes, the softest with an amplitude of `first` angstrom."""
    values, vectors = np.linalg.eigh(hessian(coords, cutoff))
    values, vectors = values[6:], vectors[:, 6:]
    width = np.maximum(values, 1e-6) ** -0.5
    weights = rng.normal(0, 1, size=(n_frames, len(width))) * (width * (first / width[0]))
    return coords + (weights @ vectors.T).reshape(n_frames, *coords.shape)


def jitter(coords: np.ndarray, rng: np.random.Generator, deviation: float, n_frames: int = FRAMES) -> np.ndarray:
    """The structure with independent Gaussian noise in each frame."""
    return coords + rng.normal(0, deviation, size=(n_frames, *coords.shape))


def synthetic_baselines(coords: np.ndarray, seed: int = SEED) -> dict[str, np.ndarray]:
    """The three generated baselines, from one stream in this order."""
    rng = np.random.default_rng(seed)
    return {"anm_ensemble": network_ensemble(coords, rng), "isotropic_noise": jitter(coords, rng, 0.5), "duplicated_minimum": jitter(coords, rng, 1e-4)}


def truncated(frames: DataFrame, lengths: dict[str, int]) -> DataFrame:
    """Prefixes of a trajectory: traj_id becomes each name, frame < length."""
    spark = frames.sparkSession
    table = F.broadcast(spark.createDataFrame(sorted(lengths.items()), "_name string, _length int"))
    return frames.join(table, F.col("frame") < F.col("_length")).drop("traj_id", "_length").withColumnRenamed("_name", "traj_id")


def judged(tests: DataFrame, clocks: DataFrame, fraction: float, claimed_ns: float = 1.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys (of both tables), baseline, must_pass, passed, correct, rmsip, z_score, h0_rejected, clock_ok.

    tests: baseline, rmsip, z_score, h0_rejected; clocks: baseline, measurable, elapsed_ps. A baseline without a clock has no time.
    """
    spark = tests.sparkSession
    want = spark.createDataFrame([(i, n, m) for i, (n, m) in enumerate(BASELINES)], "at int, baseline string, must_pass boolean")
    ok = F.coalesce(F.col("measurable") & (F.col("elapsed_ps") / (claimed_ns * 1000.0) >= fraction), F.lit(False))
    out = want.join(tests, "baseline").join(clocks.select(*keys, "baseline", "measurable", "elapsed_ps"), [*keys, "baseline"], "left")
    out = out.withColumn("clock_ok", ok).withColumn("passed", F.col("h0_rejected") & F.col("clock_ok"))
    return out.orderBy(*keys, "at").select(*keys, "baseline", "must_pass", "passed", (F.col("passed") == F.col("must_pass")).alias("correct"), "rmsip", "z_score", "h0_rejected", "clock_ok")
