"""A seeded job directory, bundle and contract: a chain with soft motions in a box of diffusing water."""

import json
from pathlib import Path

import numpy as np

from framewright.operators.nulls import network_modes
from framewright.sources.frames import write_dcd, write_f32
from framewright.sources.pdb import pdb_line


def chain(n: int, rng: np.random.Generator) -> np.ndarray:
    t = np.arange(3 * n)
    return np.stack([9 * np.cos(t / 3.1), 9 * np.sin(t / 3.1), 1.1 * t], axis=1) * 0.6 + rng.normal(0, 0.3, (3 * n, 3))


def motions(coords: np.ndarray, rng: np.random.Generator, basis: np.ndarray, n: int) -> np.ndarray:
    width = 2.0 * 0.85 ** np.arange(basis.shape[1])
    move = (rng.normal(0, 1, (n, basis.shape[1])) * width) @ basis.T
    return coords + move.reshape(n, -1, 3) + rng.normal(0, 0.05, (n, *coords.shape))


def waters(n_frames: int, n: int, box: float, d: float, rng: np.random.Generator, dt: float = 1.0) -> np.ndarray:
    """Positions in nm, wrapped into the box, of Brownian tracers with diffusion d (nm2/ps)."""
    walk = np.cumsum(rng.normal(0, np.sqrt(2 * d * dt), (n_frames, n, 3)), axis=0) + rng.random((n, 3)) * box
    return walk % box


def submission(root: Path, n_res: int = 14, n_frames: int = 400, n_water: int = 150, seed: int = 4, temperature: float = 300.0) -> dict:
    rng = np.random.default_rng(seed)
    coords = chain(n_res, rng)
    names, n = ["N", "CA", "C"], 3 * n_res
    q, _ = np.linalg.qr(np.hstack([network_modes(coords, 9.0, 4), rng.normal(0, 1, (3 * n, 8))]))
    ref = motions(coords, rng, q[:, :10], 500)
    own = motions(coords, rng, q[:, :10], n_frames)
    lines = [pdb_line(i, names[i % 3], "GLU" if i // 3 == 2 else "ALA", "A", str(i // 3 + 1), coords[i], names[i % 3][0]) for i in range(n)]
    bundle, job = root / "bundle", root / "job"
    for d in (bundle, *(job / "nodes" / x / "artifacts" for x in ("prep_1/artifacts/..", "topo_1", "prod_2", "prod_10", "prod_3")), job / "nodes/prep_1/artifacts/merge", job / "nodes/empty"):
        d.mkdir(parents=True, exist_ok=True)
    (bundle / "reference.pdb").write_text("HEADER x\n" + "\n".join(lines) + "\nEND\n")
    write_f32(str(bundle / "reference_frames.f32"), ref)
    (bundle / "pca_atom_indices.json").write_text(json.dumps({"atom_indices": list(range(n)), "published_eigenvalues": [1.0]}))
    (job / "nodes/prep_1/artifacts/merge/a.pdb").write_text("\n".join(lines))
    water = [pdb_line(n + i, "O", "HOH", "W", str(i % 9000 + 1), (0, 0, 0), "O") for i in range(n_water)]
    top = job / "nodes/topo_1/artifacts"
    (top / "system.topology.pdb").write_text("REMARK\r\n" + "\r\n".join([*lines[:1], "TER", *lines[1:], *water]))
    mass = "".join('<Particle mass="1"/>' for _ in range(n + n_water))
    charge = "".join(f'<Particle eps="0" q="{(-1) ** i * 0.1}" sig="1"/>' for i in range(n + n_water))
    (top / "system.system.xml").write_text(f'<System><Particles>{mass}</Particles><Forces><Force type="HarmonicBondForce"/><Force type="NonbondedForce"><Particles>{charge}</Particles></Force></Forces></System>')
    (top / "amber_metadata.json").write_text(json.dumps({"parameters": {"water_model": "TIP3P"}, "forcefield_provenance": {"openmm_xml": ["amber14/tip3p.xml"]}}))
    node = lambda kind, status="completed", **m: json.dumps({"node_type": kind, "status": status, "metadata": m})
    prod = {"temperature_kelvin": temperature, "pressure_bar": 1.0, "simulation_time_ns": n_frames / 1000 if n_frames >= 1000 else 1.0, "timestep_fs": 2.0, "system_signature": {"ensemble": "NPT"}}
    (job / "nodes/prep_1/node.json").write_text(node("prep"))
    (job / "nodes/topo_1/node.json").write_text(node("topo"))
    (job / "nodes/prod_10/node.json").write_text(node("prod"))
    (job / "nodes/prod_2/node.json").write_text(node("prod", **prod))
    (job / "nodes/prod_3/node.json").write_text(node("prod", "running"))
    box = 3.0
    xyz = np.concatenate([own / 10, waters(n_frames, n_water, box, 0.003, rng)], axis=1)
    write_dcd(str(job / "nodes/prod_2/artifacts/run.dcd"), xyz * 10, np.full((n_frames, 3), box * 10))
    rg = float(np.sqrt(np.square(own / 10 - (own / 10).mean(axis=1, keepdims=True)).sum(axis=2).mean(axis=1)).mean())
    spec = lambda i, cat, **k: {"check_id": i, "check_type": i + "@1", "category": cat, "weight": 1.0, **k}
    return {
        "task_id": "T01",
        "reference": {
            "accession": "ACC1",
            "license": "CC BY 4.0",
            "pdb_ids": ["1ABC"],
            "reference_conditions": {"WAT": "tip3p", "TEMP": 300, "ENSEMBLE": "NPT"},
            "reference_system": {"PROTRES": n_res, "PROTATS": n, "heavy_atoms": n},
            "bundle": {"sha256": {}},
        },
        "scoring": {
            "deterministic_checks": [
                spec("sequence_matches_reference", "prep"),
                spec("protein_heavy_atom_count_matches_reference", "prep", total_atom_tolerance=2),
                spec("truncated_sidechains_completed", "prep", expected_complete_residues={"A:3": "GLU"}, expected_heavy_atoms_per_residue=3),
                spec("disulfide_bonds_formed", "prep", expected_pairs=[], maximum_sg_distance_angstrom=2.5),
                spec("thermodynamic_conditions_match_reference", "md", temperature_tolerance_k=1.0),
                spec("production_ran_for_one_nanosecond", "md", minimum_production_ns=1.0, require_finite_coordinates=True),
                spec("elapsed_simulated_time_is_physical", "md", minimum_measured_fraction_of_claim=0.3),
                spec("subspace_beyond_structure_only_model", "md"),
                {**spec("radius_of_gyration_is_physical", "md", minimum=round(rg - 0.05, 3), maximum=round(rg + 0.05, 3)), "weight": 0.5},
            ]
        },
    }
