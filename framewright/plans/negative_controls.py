"""The six baselines of a submission, scored side by side in one set of jobs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import controls, linalg, nulls, relational, series
from framewright.sources import pdb

from .scoring import Contract, gathered, node_paths, trajectory


def _rows(spark: SparkSession, parts: dict[str, np.ndarray]) -> DataFrame:
    rows = [(name, k, x.ravel().tolist()) for name, xyz in sorted(parts.items()) for k, x in enumerate(xyz)]
    return spark.createDataFrame(rows, "traj_id string, frame int, xyz array<double>")


def run(spark: SparkSession, job_dir: str, bundle: str, task: dict, interval_ps: float = 1.0) -> dict:
    contract = Contract(spark, bundle, task)
    null = contract.null(spark)
    fraction = {c["check_id"]: c for c in reversed(task["scoring"]["deterministic_checks"])}["elapsed_simulated_time_is_physical"]["minimum_measured_fraction_of_claim"]
    nodes = node_paths(spark, job_dir)
    topology = pdb.read_pdb(spark, f"{nodes['topo']['node']}/artifacts/system.topology.pdb").cache()
    matched = contract.resolved(topology)
    if lost := [r for r in matched if r[3] is None]:
        raise KeyError(f"contract atoms are missing: {lost[:4]}")
    traj, tracers, _ = trajectory(spark, nodes["prod"], topology, interval_ps)
    data = gathered(traj, tracer_nm=tracers, contract_nm=[r[3] for r in matched])
    real = controls.truncated(data, {"real_full_run": 2**31 - 1, "truncated_100ps": 100, "truncated_10ps": 10}).cache()
    angstrom = real.select("traj_id", "frame", F.transform("contract_nm", lambda x: x.cast("double") * 10).alias("xyz"))
    every = angstrom.unionByName(_rows(spark, controls.synthetic_baselines(contract.coords)))
    names = [n for n, _ in controls.BASELINES]
    spaces = linalg.essential_subspaces(every, {n: contract.coords for n in names}).cache()
    agreed = linalg.overlaps(spaces, contract.subspaces).select(F.col("left").alias("baseline"), F.col("rmsip").alias("observed"))
    tests = nulls.compared(null.select("rmsip"), agreed, []).withColumnRenamed("observed", "rmsip")
    clocks = series.clocks(real).withColumnRenamed("traj_id", "baseline")
    table = controls.judged(tests, clocks, fraction)
    results = [r.asDict() for r in table.collect()]
    s = null.agg(F.avg("rmsip").alias("mean"), F.stddev_pop("rmsip").alias("sd"), F.max("rmsip").alias("max"), F.count("*").alias("n")).first()
    correct = relational.all_true(spark.createDataFrame(results), "correct")
    return {"task_id": task["task_id"], "structure_only_null": {"mean": s["mean"], "sd": s.sd, "max": s["max"], "n_cutoffs": s.n}, "minimum_clock_fraction": fraction, "results": results, "all_correct": correct}
