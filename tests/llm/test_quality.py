import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from framewright.llm import quality as op
from framewright.llm.common import SPACES, WordHasher


def made(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(n):
        good = i % 3 > 0
        text = " ".join(rng.choice(words) + ("" if good else rng.choice(["###", "$$$", ""])) for _ in range(rng.randrange(5, 80)))
        rows.append((i, text, int(good)))
    return rows


def test_held_out_accuracy_and_split(spark):
    rows = made(600)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    w = op.train(docs, labels.where(~op.held_out()))
    got = op.scored(docs, w).withColumn("held_out", op.held_out()).collect()
    want = {r[0]: r[2] for r in rows}
    out = [r for r in got if r.held_out]
    assert {r.doc_id for r in out} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum((r.score >= op.THRESHOLD) == want[r.doc_id] for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in got)


def test_scores_do_not_depend_on_neighbours_or_labels_of_held_out_rows(spark):
    w = np.random.default_rng(0).normal(size=(1 << op.BITS) + 1).astype(np.float32)
    docs = spark.createDataFrame(made(50), "doc_id long, text string, score int")
    one = {r.doc_id: r.score for r in op.scored(docs.drop("score").repartition(7), w).collect()}
    two = {r.doc_id: r.score for r in op.scored(docs.drop("score").coalesce(1), w).collect()}
    assert one == two


def test_nulls_empty_repeats_and_unlabelled(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x y", "c"), (3, "x y", "d"), (3, "x y", "d")], "doc_id long, text string, _scored_text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    w = op.train(docs, labels)
    got = op.scored(docs, w)
    assert got.count() == 5 and set(got.columns) == {"doc_id", "text", "_scored_text", "score"}
    assert {r.score for r in got.collect()} == {0.5}
    assert op.scored(docs.where(F.lit(False)), w).collect() == []


def test_word_hashes_match_words_of_any_length():
    h = WordHasher(SPACES)
    texts = [b"", b"a b", b" b  a ", b"x" * 3_000_000, (b"a b " * 700_000), b"b"]
    got = dict(h.texts(texts))
    a, b = got[1]
    assert list(got[2]) == [b, a] and len(got[0]) == 0 and len(got[3]) == 1
    assert len(got[4]) == 1_400_000 and set(got[4].tolist()) == {int(a), int(b)} and list(got[5]) == [b]


def test_words_over_several_blocks_hash_like_short_ones(monkeypatch):
    from framewright.llm import common
    from framewright.llm.common import PUNCTUATION

    rng = random.Random(3)
    text = "".join(rng.choice(["a", "bc", " ", "  ", "!", "?!", "\n", "é" * 9]) for _ in range(4000)).encode()
    for h in (WordHasher(SPACES), WordHasher(SPACES, PUNCTUATION)):
        want = h.block(text)[0]
        for n in (1, 2, 7, 100, 5000):
            monkeypatch.setattr(common, "BLOCK", n)
            assert np.array_equal(np.concatenate(list(h.long(text))), want)
        monkeypatch.undo()


def test_one_long_word_takes_bounded_memory():
    import tracemalloc

    data = b"ab" * 15_000_000
    h = WordHasher(SPACES)
    list(h.long(b"x " * 10))
    tracemalloc.start()
    assert len(np.concatenate(list(h.long(data)))) == 1
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def plain_tokens(text):
    import re

    return re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7F])+|[^0-9A-Za-z\x20\x09-\x0D\x80-\U0010FFFF]+", text)


def test_features_training_and_scores_equal_plain_python():
    texts = ["Good words, good words!", "a a a a a", "x", "", "é1 ## é1 ##;", "one two three one two three one"]
    h = lambda w: int(next(op._hasher.texts([w.encode()]))[1][0])
    mixed = lambda x: int(op.mix(np.array([x % 2**64], dtype=np.uint64))[0])
    for text, got in zip(texts, op.features(texts), strict=True):
        t = [h(w) for w in plain_tokens(text)]
        want = [*t, *(mixed(a * 3 + b) for a, b in zip(t, t[1:], strict=False))]
        want += [mixed(sum((i >= k and t[i] == t[i - k]) << k for k in (1, 2, 3, 4)) + (1 << 40)) for i in range(len(t))]
        assert got.tolist() == [x >> (64 - op.BITS) for x in want]
    rng = random.Random(2)
    rows = [(np.unique(f, return_counts=True), float(rng.random() < 0.5)) for f in op.features([t for t in texts if t] * 4)]
    rows = [(u, c, y) for (u, c), y in rows]
    got = op.Ftrl().fit(rows, epochs=2)
    z, n, order = {}, {}, np.random.default_rng(7)

    def weight(i):
        if abs(z.get(i, 0.0)) <= 0.02:
            return 0.0
        return (np.sign(z[i]) * 0.02 - z[i]) / ((1 + n[i] ** 0.5) / 1.0 + 0.05)

    for _ in range(2):
        for k in order.permutation(len(rows)):
            u, c, y = rows[k]
            x = {int(i): float(v) * 8 / c.sum() for i, v in zip(u, c, strict=True)} | {1 << op.BITS: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g, old = (p - y) * v, n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) * w[i]
                n[i] = old + g * g
    want = np.zeros((1 << op.BITS) + 1)
    for i in z:
        want[i] = weight(i)
    assert np.allclose(got, want, atol=1e-6)


def test_scores_are_sparse_dot_products_and_copies_of_an_id_count_once(spark):
    rows = made(80)
    docs = spark.createDataFrame([r[:2] for r in rows] * 3 + [(0, "zz another text of the id")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    assert op.labelled_sample(docs, labels, "quality", 4000).count() == 80
    w = op.train(docs, labels)
    assert np.array_equal(w, op.train(docs.where("text not like 'zz%'").distinct(), labels))
    got = {r.text: r.score for r in op.scored(docs, w).collect()}
    for text, f in zip(got, op.features(list(got)), strict=True):
        dot = sum(float(w[i]) for i in f) * 8 / max(1, len(f)) + float(w[-1])
        assert abs(got[text] - 1 / (1 + np.exp(-dot))) < 1e-9
