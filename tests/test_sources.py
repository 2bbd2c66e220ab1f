import hashlib
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.sources import bundles, frames, jobs, pdb

ROWS = [
    ("ATOM", "N", "ALA", "A", "1", (1.5, -2.25, 3.0), "N"),
    ("ATOM", "1HG", "ALA", "A", "52A", (0, 0, 0), ""),
    ("HETATM", "D1", "GLU", " ", "7", (9, 9, 9), "d"),
    ("ATOM", "CA", "CYS", "B", "1", (-1, 0, 123.456), "C"),
]


def text(end="\n"):
    lines = [pdb.pdb_line(i, *r[1:], record=r[0]) for i, r in enumerate(ROWS)]
    return end.join(["HEADER  X", lines[0], "TER", *lines[1:], "END"])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_pdb_scan(spark, tmp_path, end):
    (tmp_path / "a.pdb").write_bytes(text(end).encode())
    got = pdb.read_pdb(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [r.ordinal for r in got] == [0, 1, 2, 3]
    assert [(r.atom_name, r.resid, r.chain, r.resname) for r in got] == [("N", "1", "A", "ALA"), ("1HG", "52A", "A", "ALA"), ("D1", "7", " ", "GLU"), ("CA", "1", "B", "CYS")]
    assert [r.element for r in got] == ["N", "1", "D", "C"]
    assert (got[0].x, got[0].y, got[3].z) == (1.5, -2.25, 123.456)


def test_pdb_bad_number_raises(spark, tmp_path):
    (tmp_path / "a.pdb").write_text(text().replace("   1.500", "   x.500"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        pdb.read_pdb(spark, str(tmp_path)).collect()


def test_float32_frames(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(600, 5, 3)).astype(np.float32)
    frames.write_f32(str(tmp_path / "f.f32"), x)
    got = frames.read_f32(spark, str(tmp_path / "f.f32"), 5, [4, 1]).orderBy("frame").collect()
    assert np.allclose(np.array([r.xyz for r in got]).reshape(-1, 2, 3), x[:, [4, 1]])
    (tmp_path / "bad.f32").write_bytes(b"\0" * 61)
    with pytest.raises(Exception, match="no whole number of frames"):
        frames.read_f32(spark, str(tmp_path / "bad.f32"), 5).collect()


@pytest.mark.parametrize("boxed", [True, False])
def test_dcd_round_trip_by_partitions(spark, tmp_path, boxed):
    x = np.random.default_rng(1).normal(size=(23, 7, 3)) * 10
    box = np.full((23, 3), 30.0) if boxed else None
    path = str(tmp_path / "t.dcd")
    frames.write_dcd(path, x, box)
    spark.dataSource.register(frames.DcdDataSource)
    df = spark.read.format("dcd").options(path=path, framesPerPartition="5", atoms="6,0", frameIntervalPs="2.5").load()
    assert df.rdd.getNumPartitions() == 5
    got = df.orderBy("frame").collect()
    assert np.allclose(np.array([r.xyz_nm for r in got]).reshape(23, 2, 3), x[:, [6, 0]] / 10, atol=1e-6)
    assert [r.time_ps for r in got] == [2.5 * k for k in range(23)]
    assert all(r.box_nm == ([3.0] * 3 if boxed else None) for r in got)
    (tmp_path / "no.dcd").write_bytes(struct.pack("<i", 84) + b"XXXX" + b"\0" * 80)
    with pytest.raises(ValueError):
        frames.DcdLayout(str(tmp_path / "no.dcd"))


def test_long_frames(spark):
    df = spark.createDataFrame([("t", 0, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])], "traj_id string, frame int, xyz array<float>")
    assert [tuple(r) for r in frames.long_frames(df).orderBy("atom").collect()] == [("t", 0, 0, 1.0, 2.0, 3.0), ("t", 0, 1, 4.0, 5.0, 6.0)]


def test_nodes_latest_completed(spark, tmp_path):
    for name, kind, status in (("p_10", "prod", "completed"), ("p_2", "prod", "completed"), ("p_3", "prod", "running"), ("t", "topo", "completed")):
        d = tmp_path / "nodes" / name
        d.mkdir(parents=True)
        (d / "node.json").write_text(json.dumps({"node_type": kind, "status": status, "metadata": {"simulation_time_ns": 1, "unknown": {}}}))
    (tmp_path / "nodes" / "empty").mkdir()
    got = {r.node_type: r.node.rsplit("/", 1)[1] for r in jobs.latest_completed(jobs.read_nodes(spark, str(tmp_path))).collect()}
    assert got == {"prod": "p_2", "topo": "t"}


def test_system_xml(spark, tmp_path):
    (tmp_path / "s.xml").write_text('<System><Particles><Particle mass="1"/><Particle mass="2"/></Particles><Forces><Force type="Other"><Particles><Particle q="9"/></Particles></Force><Force type="NonbondedForce"><Particles><Particle q="0.25" sig="1"/><Particle q="-0.5"/></Particles></Force></Forces></System>')
    r = jobs.read_system_xml(spark, str(tmp_path / "s.xml")).first()
    assert (r.particles, r.nonbonded, r.charge) == (2, 2, -0.25)
    (tmp_path / "bad.xml").write_text("<System>")
    with pytest.raises(Exception):
        jobs.read_system_xml(spark, str(tmp_path / "bad.xml")).collect()


def test_fetch_from_a_local_mirror(spark, tmp_path):
    root = tmp_path / "api" / "ACC"
    root.mkdir(parents=True)
    about = {"LICENSE": "CC BY 4.0", "SYSTATS": 4, "PDBIDS": ["1ABC"], "FF": ["x"]}
    (root / "project.json").write_text(json.dumps({"metadata": about, "totalFrames": 1000000}))
    (root / "pca.json").write_text(json.dumps({"data": {"atoms": [1, 0], "eigenvalues": list(range(30))}}))
    (root / "structure").write_text(text())
    (root / "trajectory").write_bytes(b"\0" * (3 * 4 * 4 * 5 + 7))
    out = tmp_path / "bundle"
    got = bundles.fetch_bundle(spark, f"file://{tmp_path}/api", "ACC", str(out))
    assert got["frame_selector"] == "1:1000000:2000" and got["n_frames"] == 5 and got["frame_bytes"] == 48
    assert got["sha256"]["reference.pdb"] == hashlib.sha256(text().encode()).hexdigest()
    assert set(got["sha256"]) == {"reference.pdb", "reference_frames.f32", "pca_atom_indices.json"}
    assert json.loads((out / "pca_atom_indices.json").read_text())["published_eigenvalues"] == list(range(20))
    assert json.loads((out / "provenance.json").read_text()) == got
    ok = bundles.verified(bundles.digests(spark, str(out)), got["sha256"] | {"absent": "0" * 64})
    assert {r.name: r.ok for r in ok.collect()} == dict.fromkeys(got["sha256"], True) | {"absent": False}


def test_strict_types_of_digests(spark):
    from framewright.functions.scalars import is_digest, is_licensed

    df = spark.createDataFrame([("a" * 64, "cc by 4.0"), ("A" * 64, "CC0"), ("a" * 65, "MIT"), (None, None)], "d string, l string")
    assert [tuple(r) for r in df.select(is_digest(F.col("d")), is_licensed(F.col("l"))).collect()] == [(True, True), (False, True), (False, False), (False, False)]


def test_dcd_of_either_byte_order_and_mark_size(spark, tmp_path):
    import struct

    rng = np.random.default_rng(3)
    xyz, box = rng.normal(0, 9, (5, 7, 3)).astype(np.float32), np.full((5, 3), 30.0)

    def write(path, order, mark, fixed=0):
        block = lambda b: struct.pack(order + mark, len(b)) + b + struct.pack(order + mark, len(b))
        head = [5, 0, 1, 5, 0, 0, 0, 0, fixed, 0, 1, *[0] * 8, 24]
        out = block(b"CORD" + struct.pack(order + "20i", *head)) + block(struct.pack(order + "i", 1) + b" " * 80) + block(struct.pack(order + "i", 7))
        for k in range(5):
            out += block(struct.pack(order + "6d", box[k, 0], 90, box[k, 1], 90, 90, box[k, 2]))
            for a in range(3):
                out += block(xyz[k, :, a].astype(order + "f4").tobytes())
        path.write_bytes(out)

    for order in "<>":
        for mark in "iq":
            path = tmp_path / f"t{'lb'[order == '>']}{mark}.dcd"
            write(path, order, mark)
            got = frames.read_dcd(spark, str(path), [6, 2], 2.0, "t").orderBy("frame").collect()
            assert [r.time_ps for r in got] == [0.0, 2.0, 4.0, 6.0, 8.0] and got[0].box_nm == [3.0, 3.0, 3.0]
            assert np.allclose([r.xyz_nm for r in got], xyz[:, [6, 2]].reshape(5, -1) / 10, atol=1e-6)
    write(tmp_path / "fixed.dcd", "<", "i", 2)
    with pytest.raises(ValueError, match="fixed"):
        frames.DcdLayout(str(tmp_path / "fixed.dcd"))


def counted(monkeypatch):
    """The bytes that sources read from files they open."""
    from framewright.sources import files

    total = [0]

    class Stream:
        def __init__(self, path):
            self.f = open(files.local_path(path), "rb", buffering=0)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def read(self, n=-1):
            got = self.f.read(n)
            total[0] += len(got)
            return got

        def seek(self, *a):
            return self.f.seek(*a)

        def tell(self):
            return self.f.tell()

    monkeypatch.setattr(frames, "seekable", Stream)
    return total


def test_float32_file_over_2_gib_in_many_tasks(spark, tmp_path):
    n_atoms, n = 40_000, 4700  # 2.1 GiB
    path = tmp_path / "large.f32"
    marks = {0: 1.5, 1234: 2.5, n - 1: 3.5}
    with open(path, "wb") as f:
        f.truncate(12 * n_atoms * n)  # a sparse file: zeros but for the marks
        for k, v in marks.items():
            f.seek(12 * (n_atoms * k + 7))
            f.write(np.array([v, v, v], dtype="<f4").tobytes())
    assert path.stat().st_size > 2 << 30
    df = frames.read_f32(spark, str(path), n_atoms, [7, 3])
    assert df.rdd.getNumPartitions() >= 30
    got = df.agg(F.count("*").alias("n"), F.count_distinct("frame").alias("d"), F.max("frame").alias("last")).first()
    assert (got.n, got.d, got["last"]) == (n, n, n - 1)
    some = {r.frame: r.xyz for r in df.where(F.exists("xyz", lambda x: x != 0)).collect()}
    assert some == {k: [v, v, v, 0, 0, 0] for k, v in marks.items()}


@pytest.mark.parametrize("each", [1, 100, 1 << 20])
def test_float32_ranges_hold_every_frame_once(spark, tmp_path, each):
    x = np.random.default_rng(1).normal(size=(23, 4, 3)).astype("<f4")
    frames.write_f32(str(tmp_path / "a.f32"), x)
    frames.write_f32(str(tmp_path / "b.f32"), x[:1])
    (tmp_path / "c.f32").write_bytes(b"")
    rows = frames.read_f32(spark, f"{tmp_path}/*.f32", 4, task_bytes=each).collect()
    got = sorted((r.file.rsplit("/", 1)[1], r.frame, tuple(r.xyz)) for r in rows)
    assert got == sorted([("a.f32", i, tuple(f.ravel().tolist())) for i, f in enumerate(x)] + [("b.f32", 0, tuple(x[0].ravel().tolist()))])
    (tmp_path / "broken.f32").write_bytes(b"x" * 50)
    with pytest.raises(Exception, match="no whole number"):
        frames.read_f32(spark, f"{tmp_path}/broken.f32", 4).collect()


def test_dcd_reads_only_wanted_frames_and_atoms(spark, tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

    x = np.random.default_rng(2).normal(0, 10, (200, 500, 3)).astype(np.float32)
    path = str(tmp_path / "t.dcd")
    frames.write_dcd(path, x, np.full((200, 3), 30.0))
    total = counted(monkeypatch)
    frames.DcdLayout(path)
    head = total[0]

    def read(filters, **options):
        reader = frames.PushingDcdReader({"path": path, "framesPerPartition": "16", **options})
        left = list(reader.pushFilters(filters))
        parts = reader.partitions()
        total[0] = 0
        got = [(f, np.array(v).reshape(-1, 3)) for p in parts for b in reader.read(p) for f, v in zip(b.column(1).to_pylist(), b.column(4).to_pylist(), strict=True)]
        return got, total[0] - head * len(parts) * bool(parts[0].path), left

    frame_bytes = 56 + 3 * (4 * 500 + 8)
    every, size, _ = read([])
    assert len(every) == 200 and size >= 200 * frame_bytes
    some, size, left = read([GreaterThanOrEqual(("frame",), 50), LessThan(("frame",), 60), In(("frame",), (1, 2)), EqualTo(("traj_id",), "t")])
    assert [f for f, _ in some] == list(range(50, 60)) and size < 11 * frame_bytes and [type(f) for f in left] == [In, EqualTo]
    strided, size, _ = read([GreaterThanOrEqual(("frame",), 30)], frames="5:150:25")
    assert [f for f, _ in strided] == [30, 55, 80, 105, 130] and size < 6 * frame_bytes
    few, size, _ = read([], frames="::40", atoms="12,10")
    assert [f for f, _ in few] == [0, 40, 80, 120, 160] and size < 5 * frame_bytes / 10
    assert all(np.allclose(v, x[f][[12, 10]] / 10, atol=1e-5) for f, v in few)
    assert read([EqualTo(("frame",), 900)])[0] == [] and read([LessThan(("frame",), 0)])[0] == []
    monkeypatch.undo()
    df = frames.read_dcd(spark, path, [3], traj_id="t").where("frame >= 190 and frame <= 191 and time_ps > 190")
    assert [r.frame for r in df.collect()] == [191]
    assert frames.read_dcd(spark, "file:" + path, [3], frames="::50").where("frame <> 50").count() == 3


def test_digest_of_a_3_gib_file_in_little_memory(spark, tmp_path):
    import hashlib
    import subprocess
    import sys

    from framewright.sources import bundles

    path = tmp_path / "large.bin"
    with open(path, "wb") as f:
        f.write(b"head")
        f.truncate(3 << 30)
    code = "import resource, sys; from framewright.sources.bundles import streamed_sha256; a = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; print(streamed_sha256(sys.argv[1]), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - a) // 1024)"
    digest, grown = subprocess.run([sys.executable, "-c", code, str(path)], capture_output=True, text=True, check=True).stdout.split()
    want = hashlib.sha256(b"head")
    for _ in range(3071):
        want.update(bytes(1 << 20))
    want.update(bytes((1 << 20) - 4))
    assert digest == want.hexdigest() and int(grown) < 100
    (tmp_path / "small.txt").write_bytes(b"abc")
    got = {r.name: (r.length, r.sha256) for r in bundles.digests(spark, f"{tmp_path}/*").collect()}
    assert got == {"large.bin": (3 << 30, digest), "small.txt": (3, hashlib.sha256(b"abc").hexdigest())}
