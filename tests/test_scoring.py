import json

import numpy as np
import pytest

from framewright.plans import negative_controls, scoring
from tests.synthetic import submission


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    root = tmp_path_factory.mktemp("score")
    return root, submission(root)


def test_every_check_of_a_good_run_passes(spark, made):
    root, task = made
    table, report = scoring.score(spark, str(root / "job"), str(root / "bundle"), task)
    bad = [r for r in report["checks"] if not r["passed"]]
    assert not bad and report["total"] == 14 == report["passed"]
    assert [r["check_id"] for r in report["checks"]][:3] == ["sequence_matches_reference", "protein_heavy_atom_count_matches_reference", "truncated_sidechains_completed"]
    assert report["by_category"]["prep"]["total"] + report["by_category"]["md"]["total"] == 14
    assert report["diagnostics"]["n_frames"] == 400 and len(report["diagnostics"]["canonical_correlations"]) == 10
    assert {r.status for r in table.collect()} == {"passed"}
    json.dumps(report)


def test_missing_contract_atom_is_not_evaluable(spark, made, tmp_path):
    task = submission(tmp_path)
    top = tmp_path / "job/nodes/topo_1/artifacts/system.topology.pdb"
    top.write_text(top.read_text().replace(" CA   ALA A   1 ", " CX   ALA A   1 "))
    _, report = scoring.score(spark, str(tmp_path / "job"), str(tmp_path / "bundle"), task)
    status = {r["check_id"]: r["status"] for r in report["checks"]}
    assert status["contract_atoms_resolvable"] == "failed" and status["subspace_beyond_structure_only_model"] == "not_evaluable"
    assert status["radius_of_gyration_is_physical"] == "passed" and report["total"] == 14


def test_wrong_conditions_and_strict_digests(spark, made, tmp_path):
    task = submission(tmp_path, temperature=301.5)
    task["reference"]["bundle"]["sha256"] = {"reference.pdb": "0" * 64}
    _, report = scoring.score(spark, str(tmp_path / "job"), str(tmp_path / "bundle"), task, strict=True)
    failed = {r["check_id"] for r in report["checks"] if not r["passed"]}
    assert failed == {"thermodynamic_conditions_match_reference", "bundle_matches_its_digests"}


def test_negative_controls(spark, made):
    root, task = made
    report = negative_controls.run(spark, str(root / "job"), str(root / "bundle"), task)
    got = {r["baseline"]: r for r in report["results"]}
    assert list(got) == ["real_full_run", "truncated_100ps", "truncated_10ps", "anm_ensemble", "isotropic_noise", "duplicated_minimum"]
    assert got["real_full_run"]["passed"] and report["all_correct"], report
    assert not any(got[b]["clock_ok"] for b in ("anm_ensemble", "isotropic_noise", "duplicated_minimum", "truncated_10ps"))
    _, scored = scoring.score(spark, str(root / "job"), str(root / "bundle"), task)
    assert np.isclose(got["real_full_run"]["rmsip"], scored["diagnostics"]["rmsip"])
    assert report["structure_only_null"]["n_cutoffs"] == 27


def test_no_completed_node(spark, tmp_path):
    task = submission(tmp_path)
    (tmp_path / "job/nodes/topo_1/node.json").write_text('{"node_type": "topo", "status": "running"}')
    with pytest.raises(SystemExit):
        scoring.score(spark, str(tmp_path / "job"), str(tmp_path / "bundle"), task)
