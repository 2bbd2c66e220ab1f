import random
import re
import zlib
from collections import Counter

import numpy as np

from framewright.llm import rules as op


def plain(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= {i, i + 1, i + 2}
    dup, seen = 0, set()
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
        seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed)


def test_base_columns_equal_plain_python(spark):
    rng = random.Random(3)
    bits = ["a", "b", "é😀", "#", "|x", "a b c", "\n", "\n", " ", "\t", " \x0b", "Z", " ", "9"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(150))) for _ in range(400)] + [None, "", " \n ", "w " * 30000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 kept", "2 rule")
    labels = spark.createDataFrame([(1, None), (None, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in op.judged(docs, labels).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(t), t
        assert r.kept == (not r.base_failed) and r.rule is None
    assert op.judged(docs.limit(0), labels).collect() == []


def test_list_finds_planted_rules_and_column_agrees(spark):
    rng = np.random.default_rng(0)
    n = 3000
    x = {k: rng.random(n) for k in op.measures()}
    bad = ((x["symbols"] > 0.8) & (x["upper"] < 0.5)) | (x["digits"] > 0.9)
    rules = op.learn(x, bad, rng.integers(0, 3, n))
    said = np.zeros(n, dtype=bool)
    for r in rules:
        said |= op.covers(r, x)
    assert (said == bad).mean() > 0.98 and 2 <= len(rules) <= 12


def test_held_out_accuracy(spark):
    rng = random.Random(8)
    rows = []
    for i in range(500):
        junk = i % 4 == 0
        words = [f"w{rng.randrange(10**6)}" + ("##" if junk and rng.random() < 0.6 else "") for _ in range(rng.randrange(55, 120))]
        rows.append((i, " ".join(words), int(not junk)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(7, rows[7][1]), (None, rows[0][1])], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if not held(r[0])], "doc_id long, quality int")
    got = op.judged(docs, labels).collect()
    assert len(got) == 502
    want = {r[0]: bool(r[2]) for r in rows}
    out = [r for r in got if r.doc_id is not None and held(r.doc_id)]
    assert sum(r.kept == want[r.doc_id] for r in out) >= 0.97 * len(out)


def test_long_texts_count_alike(monkeypatch):
    rng = random.Random(1)
    bits = ["a", "b", "é😀", "#", "|x", "a b c", "\n", "\n", " ", "\t", "Z", "9", ".", "x" * 40]
    for n in (0, 3, 40, 400):
        text = "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(n))
        want = op.statistics(text)
        assert op._long_statistics(text.encode(), len(text)) == want
    assert op.statistics("ab " * 1_000_000)[:5] == (1_000_000, 2_000_000, 0, 0, 1_000_000)
    assert op.statistics("x" * 3_000_000)[-1] == 3_000_000


def test_rules_grow_and_prune_like_plain_python():
    rng = np.random.default_rng(4)
    n = 600
    x = {k: rng.random(n) for k in op.measures()}
    bad = (x["symbols"] > 0.7) | (x["digits"] > 0.95)
    rules = op.learn(x, bad, rng.integers(0, 3, n))
    left = np.ones(n, dtype=bool)
    for r in rules:  # each rule covers rows that no earlier one did, most of them bad
        now = op.covers(r, x) & left
        assert now.any() and bad[now].mean() > 0.5
        left &= ~now
    assert (bad & left).mean() < 0.02
