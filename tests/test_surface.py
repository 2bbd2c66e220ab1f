import json
import subprocess
import sys

import pytest

from tests.synthetic import submission

VERBS = {"list_benchmark_tasks", "fetch_benchmark_reference", "score_benchmark_submission", "run_benchmark_negative_controls"}


def test_package_and_verbs_import_without_spark():
    code = "import sys, framewright; assert set(framewright.tools()) == %r; assert not {'pyspark', 'numpy'} & set(sys.modules)" % VERBS
    subprocess.run([sys.executable, "-c", code], check=True)


def test_list_flag(capsys):
    from framewright.__main__ import main

    assert main(["--list"]) == 0
    assert {t["name"] for t in json.loads(capsys.readouterr().out)["tools"]} == VERBS


def test_flags_are_those_of_the_verbs():
    import inspect

    from framewright import tools
    from framewright.__main__ import REQUIRED, VERBS, parser

    args = parser().parse_args(["score_benchmark_submission", "--job-dir", "j", "--bundle", "b", "--task-file", "t", "--strict"])
    assert args.strict is True and args.out is None
    args = parser().parse_args(["fetch_benchmark_reference", "--accession", "A", "--out", "o", "--api", "file:///x", "--n-frames", "7"])
    assert args.n_frames == 7
    with pytest.raises(SystemExit):
        parser().parse_args(["score_benchmark_submission"])
    for verb in VERBS:
        own = inspect.signature(tools()[verb.name]).parameters
        assert {f.name: f.default for f in verb.flags} == {k: REQUIRED if p.default is p.empty else p.default for k, p in own.items()}


def test_bad_inputs_are_told_and_fail(capsys, tmp_path):
    from framewright.__main__ import main

    assert main(["fetch_benchmark_reference", "--accession", "A", "--out", str(tmp_path / "o"), "--api", f"file://{tmp_path}"]) == 1
    got = json.loads(capsys.readouterr().out)
    assert got["success"] is False and "URLError" in got["error"]


def test_thread_guard_is_set_before_numpy_loads():
    code = "import os; [os.environ.pop(k, None) for k in ('OMP_NUM_THREADS', 'OPENBLAS_NUM_THREADS', 'MKL_NUM_THREADS')]; import framewright, sys; assert int(os.environ['OPENBLAS_NUM_THREADS']) <= 8 and 'numpy' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_list_tasks_and_score_through_the_command_line(spark, tmp_path, capsys):
    from framewright.__main__ import main

    task = submission(tmp_path, n_frames=60)
    for name in ("B", "A"):
        d = tmp_path / "data" / "tasks" / name
        d.mkdir(parents=True)
        (d / "task.json").write_text(json.dumps(task | {"task_id": name}))
    assert main(["list_benchmark_tasks", "--dataset-dir", str(tmp_path / "data")]) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["total"] == 2 and [t["task_id"] for t in got["tasks"]] == ["A", "B"] and got["tasks"][0]["checks"] == {"prep": 4, "md": 5}
    assert got["tasks"][0]["prompt_file"].endswith("tasks/A/prompt.md")
    args = ["--job-dir", str(tmp_path / "job"), "--bundle", str(tmp_path / "bundle"), "--task-file", got["tasks"][0]["task_file"]]
    assert main(["score_benchmark_submission", *args, "--out", str(tmp_path / "r.json")]) == 0
    assert json.loads(capsys.readouterr().out)["success"] and json.loads((tmp_path / "r.json").read_text())["total"] == 14
    assert main(["run_benchmark_negative_controls", *args]) in (0, 1)


def test_completion_stream(spark, tmp_path):
    from framewright.streaming.nodes import on_completion

    seen = []
    for k, status in enumerate(("completed", "running")):
        d = tmp_path / "job" / "nodes" / f"n{k}"
        d.mkdir(parents=True)
        (d / "node.json").write_text(json.dumps({"node_type": "prod", "status": status}))
    act = lambda batch, _: seen.extend(r.path.split("/")[-2] for r in batch.collect())
    on_completion(spark, str(tmp_path / "job"), str(tmp_path / "cp"), act, once=True).awaitTermination()
    d = tmp_path / "job" / "nodes" / "n2"
    d.mkdir()
    (d / "node.json").write_text(json.dumps({"node_type": "prod", "status": "completed"}))
    on_completion(spark, str(tmp_path / "job"), str(tmp_path / "cp"), act, once=True).awaitTermination()
    assert seen == ["n0", "n2"]


def test_jobs_are_handed_on_once_when_all_their_nodes_are_complete(spark, tmp_path):
    from framewright.streaming import nodes

    def node(job, name, kind, status="completed"):
        folder = tmp_path / "jobs" / job / "nodes" / name
        folder.mkdir(parents=True)
        (folder / "node.json").write_text(json.dumps({"node_type": kind, "status": status}))

    for job in ("a", "b", "c"):
        node(job, "prep_1", "prep")
        node(job, "topo_1", "topo")
    node("a", "prod_1", "prod")
    node("b", "prod_1", "prod", "failed")
    got = []

    def follow():
        query = nodes.ready_jobs(spark, str(tmp_path / "jobs")).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "at")).foreachBatch(lambda df, _: got.extend(tuple(x.rsplit("/jobs/", 1)[1] for x in r) for r in df.collect())).trigger(availableNow=True).start()
        query.awaitTermination(120)

    follow()
    assert got == [("a", "a/nodes/prep_1", "a/nodes/topo_1", "a/nodes/prod_1")]
    node("a", "prod_2", "prod")
    node("b", "prod_2", "prod")
    node("b", "prep_2", "prep")
    node("d", "prod_1", "prod")
    follow()
    assert got[1:] == [("b", "b/nodes/prep_2", "b/nodes/topo_1", "b/nodes/prod_2")]
