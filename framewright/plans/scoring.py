"""Scoring of one submission: every check as a row, then the rollup and the report.

Checks are emitted in a fixed order with a status: "passed", "failed" or "not_evaluable" (a
contract atom is missing, so the subspace cannot be compared; the other checks still stand).
`strict` applies what contracts declare beyond the default rules: the total atom tolerance, finite
coordinates, digests of the bundle, and limits read from the checks.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.scalars import is_protein, is_water_oxygen
from framewright.operators import linalg, nulls, relational, series
from framewright.sources import bundles, files, frames, jobs, pdb

RESULT = "at int, check_id string, status string, passed boolean, detail string"


def _one(spark: SparkSession, pattern: str) -> str:
    """The first file in path order that a glob matches."""
    folder, name = pattern.rsplit("/", 1)
    found = spark.read.format("binaryFile").option("pathGlobFilter", name).load(folder).agg(F.min("path")).first()[0]
    if found is None:
        raise FileNotFoundError(pattern)
    return found


def node_paths(spark: SparkSession, job_dir: str) -> dict[str, dict]:
    """node folder and metadata of the latest completed prep, topo and prod nodes."""
    rows = {r.node_type: r.asDict(True) for r in jobs.latest_completed(jobs.read_nodes(spark, job_dir)).collect()}
    for kind in ("prep", "topo", "prod"):
        if kind not in rows:
            raise SystemExit(f"no completed {kind} node under {job_dir}")
    return rows


class Contract:
    """A bundle's contract atoms and the reference trajectory's subspace."""

    def __init__(self, spark: SparkSession, bundle: str, task: dict):
        atoms = pdb.read_pdb(spark, f"{bundle}/reference.pdb")
        with files.seekable(f"{bundle}/pca_atom_indices.json") as f:
            self.indices = json.loads(f.read())["atom_indices"]
        index = spark.createDataFrame([(self.indices,)], "atom_indices array<int>")
        self.keys = relational.contract_keys(atoms, index).orderBy("k").cache()
        self.coords = np.array([(r.x, r.y, r.z) for r in self.keys.collect()])
        n = task["reference"]["reference_system"]["PROTATS"]
        got = frames.read_f32(spark, f"{bundle}/reference_frames.f32", n, self.indices).withColumn("traj_id", F.lit("reference"))
        with files.seekable(f"{bundle}/reference_frames.f32") as f:
            f.seek(0, 2)
            size = f.tell() // (12 * n)
        self.subspaces = linalg.essential_subspaces(got, {"reference": self.coords}, sizes={"reference": size}).cache()
        self.modes = linalg.frame_of(self.subspaces, "reference")
        self._null = None

    def null(self, spark: SparkSession) -> DataFrame:
        """The network sweep; it depends on the reference alone and is kept."""
        if self._null is None:
            self._null = nulls.network_null(spark, {"reference": (self.coords, self.modes)}).cache()
            self._null.count()
        return self._null

    def resolved(self, topology: DataFrame) -> list[tuple]:
        """(k, resid, atom_name, own ordinal or None) in contract order."""
        return [(r.k, r.resid, r.atom_name, r.own_ordinal) for r in relational.resolve_contract(self.keys, topology).orderBy("k").collect()]


def trajectory(spark: SparkSession, prod: dict, topology: DataFrame, interval_ps: float) -> tuple[Callable[[list[int]], DataFrame], list[int], list[int]]:
    """A reader of given atoms of the production frames, and the ordinals of the tracers and of the protein."""
    rows = topology.select("ordinal", is_water_oxygen(F.col("resname"), F.col("atom_name")).alias("w"), is_protein(F.col("resname")).alias("p")).where("w or p").orderBy("ordinal").collect()
    tracers = series.sample_tracers([r.ordinal for r in rows if r.w])
    path = _one(spark, f"{prod['node']}/artifacts/*.dcd").removeprefix("file:")
    return lambda atoms: frames.read_dcd(spark, path, atoms, interval_ps, "submission"), tracers, [r.ordinal for r in rows if r.p]


def gathered(read: Callable[[list[int]], DataFrame], **atoms: list[int]) -> DataFrame:
    """The trajectory with, for each name, the flat coordinates of its atoms; no other atom leaves the source."""
    every = np.unique(np.concatenate([np.asarray(a, dtype=np.int64) for a in atoms.values()]))
    traj = read(every.tolist())
    names = list(atoms)
    sent = traj.sparkSession.sparkContext.broadcast({n: (np.searchsorted(every, np.asarray(a, dtype=np.int64))[:, None] * 3 + np.arange(3)).ravel() for n, a in atoms.items()})

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                xyz = part.column(4).flatten().to_numpy().reshape(part.num_rows, -1)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(4)), *(lists(xyz[:, sent.value[n]]) for n in names)], ["traj_id", "frame", "time_ps", "box", *names])

    kinds = ", ".join(f"{n} array<float>" for n in names)
    return traj.select("traj_id", "frame", "time_ps", F.col("box_nm")[0].alias("box"), "xyz_nm").mapInArrow(run, f"traj_id string, frame int, time_ps double, box double, {kinds}")


def _prep_facts(spark: SparkSession, prep: str, specs: dict) -> tuple:
    """Composition row, wrong residues and broken pairs of the prepared structure."""
    atoms = pdb.read_pdb(spark, _one(spark, f"{prep}/artifacts/merge/*.pdb")).cache()
    counts, short, broken = relational.composition(atoms).first(), None, None
    if spec := specs.get("truncated_sidechains_completed"):
        expected = spark.createDataFrame([(k,) for k in spec["expected_complete_residues"]], "key string")
        short = {r.key: r.heavy for r in relational.incomplete_residues(atoms, expected, F.lit(spec["expected_heavy_atoms_per_residue"])).collect()}
    if spec := specs.get("disulfide_bonds_formed"):
        pairs = spark.createDataFrame([tuple(p) for p in spec["expected_pairs"]], "a int, b int")
        rows = relational.broken_pairs(atoms, pairs, F.lit(spec["maximum_sg_distance_angstrom"])).collect() if spec["expected_pairs"] else []
        broken = {f"{r.a}-{r.b}": "SG missing" if r.distance is None else f"{r.distance:.2f} A" for r in rows}
    atoms.unpersist()
    return counts, short, broken


def score(spark: SparkSession, job_dir: str, bundle: str, task: dict, strict: bool = False, interval_ps: float = 1.0) -> tuple[DataFrame, dict]:
    """The check table (task_id, at, check_id, category, status, passed, detail) and the report.

    Independent parts (prepared structure, system, reference, trajectory) are jobs that run side by side.
    """
    nodes = node_paths(spark, job_dir)
    topo, prod = nodes["topo"]["node"], nodes["prod"]
    meta = prod["metadata"] or {}
    system, conditions = task["reference"]["reference_system"], task["reference"]["reference_conditions"]
    specs = {c["check_id"]: c for c in reversed(task["scoring"]["deterministic_checks"])}
    rows: list[tuple] = []

    def check(check_id: str, ok: bool | None, detail: str) -> None:
        rows.append((len(rows), check_id, "not_evaluable" if ok is None else "passed" if ok else "failed", bool(ok), detail))

    with ThreadPoolExecutor(8) as pool:
        later = pool.submit
        prep_facts = later(_prep_facts, spark, nodes["prep"]["node"], specs)
        xml = later(lambda: jobs.read_system_xml(spark, f"{topo}/artifacts/system.system.xml").first())
        about = later(lambda: jobs.read_documents(spark, f"{topo}/artifacts/amber_metadata.json", jobs.AMBER).first().asDict(True))
        digests = later(lambda: sorted(r.name for r in bundles.verified(bundles.digests(spark, bundle), task["reference"]["bundle"]["sha256"]).where("not ok").collect())) if strict else None
        topology = pdb.read_pdb(spark, f"{topo}/artifacts/system.topology.pdb").cache()
        picked = later(trajectory, spark, prod, topology, interval_ps)
        contract = Contract(spark, bundle, task)
        null = later(contract.null, spark)
        random = later(lambda: nulls.random_null(spark, contract.modes.shape[0], contract.modes.shape[1], 2000).agg(F.avg("rmsip").alias("m"), F.stddev_pop("rmsip").alias("s")).first())
        matched = contract.resolved(topology)
        missing = [(r[1], r[2]) for r in matched if r[3] is None]
        own = [r[3] for r in matched if r[3] is not None]
        traj, tracers, protein = picked.result()
        data = gathered(traj, tracer_nm=tracers, contract_nm=own, protein_nm=protein).cache()
        n_frames = data.count()
        timed = later(lambda: series.clocks(data, longest=n_frames).first())
        radius = later(lambda: series.radii_of_gyration(data).agg(F.avg("rg")).first()[0])
        finite = True
        if strict and specs.get("production_ran_for_one_nanosecond", {}).get("require_finite_coordinates"):
            finite = not data.where(F.exists("protein_nm", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))).limit(1).count()
        test: dict = {}
        if not missing:
            angstrom = data.select("traj_id", "frame", F.transform("contract_nm", lambda x: x.cast("double") * 10).alias("xyz"))
            modes = linalg.frame_of(linalg.essential_subspaces(angstrom, {"submission": contract.coords}, sizes={"submission": n_frames}), "submission")
            test = nulls.test_beyond_structure(modes, contract.modes, null.result(), random.result())

        c, short, broken = prep_facts.result()
        check("sequence_matches_reference", c.residues == system["PROTRES"] and c.chains == 1, f"residues {c.residues} of {system['PROTRES']}, chains {c.chains}")
        slack = specs.get("protein_heavy_atom_count_matches_reference", {}).get("total_atom_tolerance", 0) if strict else 0
        check("protein_heavy_atom_count_matches_reference", c.heavy == system["heavy_atoms"] and abs(c.atoms - system["PROTATS"]) <= slack, f"heavy atoms {c.heavy} of {system['heavy_atoms']}, all {c.atoms} of {system['PROTATS']}")
        if spec := specs.get("truncated_sidechains_completed"):
            check("truncated_sidechains_completed", not short, f"{spec['expected_heavy_atoms_per_residue']} heavy atoms wanted in each of {len(spec['expected_complete_residues'])} residues; others: {short}")
        if spec := specs.get("disulfide_bonds_formed"):
            check("disulfide_bonds_formed", not broken, f"{len(spec['expected_pairs'])} pairs within {spec['maximum_sg_distance_angstrom']} A; broken: {broken}")
        s = xml.result()
        check("topology_loads_and_is_parameterized", s.particles > 0, f"{s.particles} particles")
        check("forcefield_applied_to_every_atom", s.nonbonded == s.particles, f"{s.nonbonded} of {s.particles} particles parameterised")
        check("system_is_neutral", abs(s.charge) < 1e-4, f"net charge {s.charge:+.2e} e")
        amber = about.result()
        water = ((amber["parameters"] or {}).get("water_model") or "").lower()
        xmls = " ".join((amber["forcefield_provenance"] or {}).get("openmm_xml") or []).lower()
        wanted = conditions["WAT"].lower()
        check("water_model_matches_reference", wanted in water and wanted in xmls, f"water model {water!r}; {wanted} in force-field files: {wanted in xmls}")
        temperature = meta.get("temperature_kelvin") or 0.0
        ensemble = (meta.get("system_signature") or {}).get("ensemble")
        within = specs.get("thermodynamic_conditions_match_reference", {}).get("temperature_tolerance_k", 1.0) if strict else 1.0
        check("thermodynamic_conditions_match_reference", abs(temperature - float(conditions["TEMP"])) <= within and ensemble == conditions["ENSEMBLE"], f"{temperature} K, {ensemble}, {meta.get('pressure_bar')} bar")
        claimed_ns = meta.get("simulation_time_ns") or 0.0
        least = specs.get("production_ran_for_one_nanosecond", {}).get("minimum_production_ns", 1.0) if strict else 1.0
        check("production_ran_for_one_nanosecond", claimed_ns >= least and finite, f"{meta.get('simulation_time_ns')} ns in steps of {meta.get('timestep_fs')} fs (HMR {meta.get('hmr')})")
        clock = timed.result()
        fraction = specs["elapsed_simulated_time_is_physical"]["minimum_measured_fraction_of_claim"]
        if not clock.measurable:
            check("elapsed_simulated_time_is_physical", False, f"not measurable: {clock.reason}")
        else:
            ratio = clock.elapsed_ps / (claimed_ns * 1000) if claimed_ns else 0.0
            check("elapsed_simulated_time_is_physical", ratio >= fraction, f"{clock.elapsed_ps:.0f} ps by diffusion, {claimed_ns * 1000:.0f} ps claimed, ratio {ratio:.2f}, D {clock.diffusion_1e5_cm2_s:.2f}e-5 cm2/s")
        check("contract_atoms_resolvable", not missing, f"{len(own)} of {len(matched)} contract atoms matched; missing {missing[:4]}")
        if missing:
            check("subspace_beyond_structure_only_model", None, "contract atoms are missing")
        else:
            z = "undefined" if test["z_score"] is None else f"{test['z_score']:.2f}"
            check("subspace_beyond_structure_only_model", test["h0_rejected"], f"RMSIP {test['rmsip']:.3f}; structure alone {test['null_mean']:.3f} +/- {test['null_sd']:.3f}, at most {test['null_max']:.3f}; z {z}, p <= {test['p_value_upper_bound']:.2f}")
        rg = radius.result()
        spec = specs["radius_of_gyration_is_physical"]
        size = math.nan if rg is None else rg
        check("radius_of_gyration_is_physical", spec["minimum"] <= size <= spec["maximum"], f"Rg {size:.4f} nm, band {spec['minimum']} to {spec['maximum']}")
        if strict:
            bad = digests.result()
            check("bundle_matches_its_digests", not bad, f"other digests: {bad}")
        data.unpersist()

    listed = [(c["check_id"], c.get("category") or "prep", float(c.get("weight", 1.0))) for c in specs.values()]
    categories = spark.createDataFrame(listed, "check_id string, category string, weight double")
    table = relational.with_category(spark.createDataFrame(rows, RESULT), categories).join(categories.select("check_id", "weight"), "check_id", "left")
    table = table.select(F.lit(task["task_id"]).alias("task_id"), "at", "check_id", "category", "status", "passed", F.coalesce("weight", F.lit(1.0)).alias("weight"), "detail").orderBy("at").cache()
    return table, report(table, task["task_id"], test, rg, n_frames)


def report(table: DataFrame, task_id: str, test: dict, rg: float | None, n_frames: int) -> dict:
    roll = {r.category: r for r in relational.category_rollup(table).collect()}
    keep = ("check_id", "category", "status", "passed", "detail")
    return {
        "task_id": task_id,
        "checks": [{k: r[k] for k in keep} for r in table.collect()],
        "by_category": {k: {"passed": r.passed, "total": r.total} for k, r in sorted((k, r) for k, r in roll.items() if k)},
        "passed": roll[None].passed,
        "total": roll[None].total,
        "diagnostics": {"rmsip": test.get("rmsip"), "z_score": test.get("z_score"), "canonical_correlations": test.get("canonical_correlations"), "rg_mean_nm": rg, "n_frames": n_frames},
    }
