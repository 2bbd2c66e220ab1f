import math
import random

import numpy as np
import pytest

from framewright.llm import hard_negatives as op


def plain(rows, k=5):
    able = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        able.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out, seen = [], set()
    for a in able:
        if a[0] % 100 or str(a) in seen:
            continue
        seen.add(str(a))
        scored = sorted((-sum(x * y for x, y in zip(a[2], v, strict=True)), i, label) for i, label, v in able if len(v) == len(a[2]) and i != a[0])
        for s, i, label in [x for x in scored if x[2] == a[1]][:k]:
            fits = [(t, j) for t, j, m in scored if m != a[1] and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(a[0], i, n, j, -s, -t) for n, (t, j) in enumerate(fits[:k], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def table(seed, n, dim=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        base = rng.choice([0.1, 0.5, -0.4])
        rows.append((i, [base + rng.gauss(0, 0.3) for _ in range(dim)], rng.randrange(4)))
    rows += [(n + i, [0.25] * dim, rng.randrange(3)) for i in range(300)]  # one vector, many rows
    rows += [(None, [0.1] * dim, 1), (n + 400, None, 1), (n + 401, [0.1] * dim, None), (n + 402, [0.1, None] * (dim // 2), 1), (n + 403, [float("nan")] * dim, 2), (n + 404, [float("inf")] * dim, 2)]
    rows += [(n + 405, [0.3] * 3, 1), (n + 500, [0.2] * 3, 2), (n + 501, [], 2), (5, rows[5][1], rows[5][2]), (100, rows[100][1], rows[100][2])]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_mined_rows_equal_brute_force(spark, monkeypatch):
    for name, value in (("TREE", 200), ("LEAF", 8), ("HELD_BYTES", 20_000)):
        monkeypatch.setattr(op, name, value)
    rows = table(1, 1200)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS q", "2 AS v", "3 AS w", "4 AS low", "5 AS block").repartition(6)
    want = plain(rows)
    assert want and rows_of(op.hard_negatives(df)) == want
    usable = op.usable(df)
    got = op.mined(usable.selectExpr("vec_id", "IF(vec_id % 7 = 0, (label + 1) % 10, label) AS label", "v"), usable.vec_id % 100 == 0, block=3)
    assert rows_of(got) == want


def test_empty_tables_and_tables_without_anchors(spark):
    assert op.hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    assert op.hard_negatives(spark.createDataFrame([(1, [0.5], 1), (2, [0.5], 2)], SCHEMA)).collect() == []
    assert op.hard_negatives(spark.createDataFrame([(100, [0.5], 1)], SCHEMA)).collect() == []


def test_large_components_are_exact(spark):
    big = float(2**20)
    rows = [(100, [big, 1.0], 1), (1, [big, 3.0], 1), (2, [big, 2.0], 2), (3, [big, -1.0], 3)]
    assert rows_of(op.hard_negatives(spark.createDataFrame(rows, SCHEMA))) == plain(rows) != []
    with pytest.raises(Exception, match="(?i)overflow|too large"):
        op.hard_negatives(spark.createDataFrame([(100, [1e30], 1), (1, [1e30], 1)], SCHEMA)).collect()


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    rows = np.floor(rng.normal(size=(4000, 8)) * 60 + rng.integers(0, 5, size=(4000, 1)) * 400)
    tree = op.Tree(rows, np.arange(4000), rng.integers(0, 3, size=4000))
    back = op.Tree.unpacked(tree.packed())
    assert (back.rows == tree.rows).all() and (back.at == tree.at).all() and (back.radius == tree.radius).all()
    for i, (lo, hi, _) in enumerate(tree.at.tolist()):
        gap = np.sqrt(np.square(tree.rows[lo:hi] - tree.centre[i]).sum(axis=1)).max()
        assert gap <= tree.radius[i] * (1 + 1e-12) and tree.least[i] == tree.ids[lo:hi].min()
    q = rows[:20]
    search = op.Search(np.arange(20), np.full(20, 1), q, np.full(20, op._LEAST), np.full(20, -(op._LEAST + 1)), True, 5)
    met = []
    leaf = op.Search._leaf
    search._leaf = lambda t, lo, hi, at, exact: (met.append((hi - lo) * len(at)), leaf(search, t, lo, hi, at, exact))
    search.walk(tree)
    for i in range(20):
        got = sorted((-int(s), j) for j, s in enumerate(rows @ q[i]) if tree.labels[np.flatnonzero(tree.ids == j)[0]] == 1 and j != i)[:5]
        assert [(-s, j) for s, j in zip(search.score[i].tolist(), search.found[i].tolist(), strict=True)] == got
    assert sum(met) < 0.5 * 20 * 4000
