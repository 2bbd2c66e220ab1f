"""The four verbs. Each takes plain values and returns a JSON-serialisable dict; Spark starts on first use."""

from __future__ import annotations

import json
from pathlib import Path

from framewright import __version__


def _session():
    from pyspark.sql import SparkSession

    from framewright.functions.ship import ship

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.executorEnv.OMP_NUM_THREADS", "1").getOrCreate()
    ship(spark)
    return spark


def list_benchmark_tasks(dataset_dir: str) -> dict:
    """List a dataset's tasks with their reference accessions and numbers of checks."""
    from framewright.operators.relational import checks_by_task
    from framewright.sources.jobs import checks_of, read_tasks

    tasks = read_tasks(_session(), dataset_dir)
    counts = {r.task_id: {"prep": r.prep, "md": r.md} for r in checks_by_task(checks_of(tasks)).collect()}
    rows = tasks.select("task_id", "reference.accession", "reference.pdb_ids", "reference.license", "path").orderBy("path").collect()
    found = []
    for r in rows:
        file = r.path.removeprefix("file://").removeprefix("file:")
        found.append({"task_id": r.task_id, "accession": r.accession, "pdb_ids": r.pdb_ids, "license": r.license, "checks": counts.get(r.task_id, {"prep": 0, "md": 0}), "task_file": file, "prompt_file": str(Path(file).parent / "prompt.md")})
    return {"success": True, "version": __version__, "total": len(found), "tasks": found}


def fetch_benchmark_reference(accession: str, out: str, api: str, n_frames: int = 500, frames: str | None = None) -> dict:
    """Download one reference bundle from a project API and record its provenance."""
    from framewright.sources.bundles import fetch_bundle

    record = fetch_bundle(_session(), api, accession, out, n_frames, frames)
    return {"success": True, "out": out} | {k: record[k] for k in ("accession", "license", "n_frames", "frame_bytes", "sha256")}


def _contract(spark, task_file: str) -> dict:
    """A task's contract, from anywhere that Spark reads."""
    return json.loads(spark.read.text(task_file, wholetext=True).first().value)


def score_benchmark_submission(job_dir: str, bundle: str, task_file: str, out: str | None = None, strict: bool = False) -> dict:
    """All checks of a job directory, their totals by category and the test's figures; `out` also gets them as a file."""
    from framewright.plans import scoring
    from framewright.sources import bundles

    spark = _session()
    report = scoring.score(spark, job_dir, bundle, _contract(spark, task_file), strict)[1]
    if out is not None:
        bundles.write_report(report, out)
    return {**report, "success": True}


def run_benchmark_negative_controls(job_dir: str, bundle: str, task_file: str) -> dict:
    """The verdict on each baseline; a success if all are as they must be."""
    from framewright.plans import negative_controls

    spark = _session()
    report = negative_controls.run(spark, job_dir, bundle, _contract(spark, task_file))
    return {**report, "success": report["all_correct"]}


TOOLS = {f.__name__: f for f in (list_benchmark_tasks, fetch_benchmark_reference, score_benchmark_submission, run_benchmark_negative_controls)}
