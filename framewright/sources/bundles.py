"""Reference bundles: fetching, frame selection, digests, provenance; and report files."""

from __future__ import annotations

import hashlib
import io
import json
import shutil
import time
from collections.abc import Iterator
from pathlib import Path
from typing import BinaryIO
from urllib.error import HTTPError, URLError
from urllib.request import urlopen

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.scalars import stride

from .files import CHUNK, all_seekable, listed, seekable, spread

#: Project fields kept in the provenance record.
CONDITIONS = ("FF", "WAT", "TEMP", "ENSEMBLE", "BOXTYPE", "TIMESTEP", "LENGTH", "PROGRAM", "METHOD")
SYSTEM = ("PROTRES", "PROTATS", "SYSTATS", "SOL", "NA", "CL")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """name, length and sha256 of files, each streamed through its digest a megabyte at a time.

    Files in a store that only Spark can open are read whole (2 GiB at most each).
    """
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    found = listed(spark, path)
    if not all_seekable(found):
        return spark.read.format("binaryFile").load(path).select(name, "length", F.sha2("content", 256).alias("sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, base, size in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([base]), pa.array([size], pa.int64()), pa.array([streamed_sha256(file)])], ["name", "length", "sha256"])

    return spread(found.select("path", name, "length"), found.count()).mapInArrow(run, "name string, length long, sha256 string")


def streamed_sha256(path: str) -> str:
    """The digest of one file, read in chunks."""
    digest = hashlib.sha256()
    with seekable(path) as f:
        while part := f.read(CHUNK):
            digest.update(part)
    return digest.hexdigest()


def verified(found: DataFrame, expected: dict[str, str]) -> DataFrame:
    """name, ok: whether each expected digest was found (a missing file is not ok)."""
    spark = found.sparkSession
    want = spark.createDataFrame(sorted(expected.items()), "name string, want string")
    return want.join(found, "name", "left").select("name", F.coalesce(F.col("want") == F.col("sha256"), F.lit(False)).alias("ok"))


def frame_count(length: int, frame_bytes: int) -> int:
    """Whole frames in a file; a rest is dropped."""
    return length // frame_bytes


def _load(url: str, seconds: int) -> bytes:
    buffer = io.BytesIO()
    _copy(url, seconds, buffer)
    return buffer.getvalue()


def _copy(url: str, seconds: int, to: BinaryIO, tries: int = 3) -> None:
    """Writes an answer's body to a file, a megabyte at a time; a broken connection is tried again."""
    for left in reversed(range(tries)):
        try:
            to.seek(0)
            to.truncate()
            with urlopen(url, timeout=seconds) as answer:
                shutil.copyfileobj(answer, to, 1 << 20)
            return
        except HTTPError as error:
            if error.code < 500 or not left:
                raise
        except (URLError, ConnectionError, TimeoutError) as error:
            if not left or isinstance(getattr(error, "reason", None), FileNotFoundError):
                raise
        time.sleep(2 ** (tries - left - 1))


def fetch_bundle(spark: SparkSession, api: str, accession: str, out: str, n_frames: int = 500, frames: str | None = None, database: str = "") -> dict:
    """Fetches a project's structure, strided frames and atom indices, and writes provenance.json.

    `api` may be any URL that urllib opens; with file:// the answers are the files
    <api>/<accession>/project.json, pca.json, structure and trajectory.
    """
    local = api.startswith("file:")
    root, target = f"{api}/{accession}", Path(out)
    target.mkdir(parents=True, exist_ok=True)
    project = json.loads(_load(f"{root}/project.json" if local else root, 120))
    about = project.get("metadata", {})
    selector = frames or stride(int(project.get("totalFrames") or about.get("SNAPSHOTS")), n_frames)
    modes = json.loads(_load(f"{root}/pca.json" if local else f"{root}/analyses/pca", 120))["data"]
    for name, part in (("reference.pdb", "structure"), ("reference_frames.f32", "trajectory" if local else f"trajectory?frames={selector}")):
        with (target / name).open("wb+") as f:
            _copy(f"{root}/{part}", 1800, f)
    (target / "pca_atom_indices.json").write_text(json.dumps({"atom_indices": modes["atoms"], "published_eigenvalues": modes["eigenvalues"][:20]}, indent=2))
    width = 3 * about["SYSTATS"] * 4
    files = {r.name: r for r in digests(spark, str(target)).where("name <> 'provenance.json'").collect()}
    record = {"database": database, "api": api, "accession": accession, "license": about.get("LICENSE"), "license_url": about.get("LINKCENSE"), "citation": about.get("CITATION"), "pdb_ids": about.get("PDBIDS")}
    record |= {"conditions": {k: about.get(k) for k in CONDITIONS}, "system": {k: about.get(k) for k in SYSTEM}}
    record |= {"frame_selector": selector, "frame_bytes": width, "n_frames": frame_count(files["reference_frames.f32"].length, width), "sha256": {n: files[n].sha256 for n in sorted(files)}}
    (target / "provenance.json").write_text(json.dumps(record, indent=2))
    return record


def write_report(report: dict, out: str) -> None:
    Path(out).write_text(json.dumps(report, indent=2))
