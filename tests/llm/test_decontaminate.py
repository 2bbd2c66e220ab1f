import random
import re
from collections import Counter

from framewright.llm import decontaminate as op


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())


def plain(text, item):
    """Best similarity over all windows of the item's length, without any fingerprint."""
    w, i = words(text), words(item)
    k = min(5, len(i))
    if not i or len(w) < k:
        return 0.0
    grams = lambda x: Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1))
    want, best = grams(i), 0.0
    for s in range(max(1, len(w) - len(i) + 1)):
        got = grams(w[s : s + len(i)])
        best = max(best, sum((got & want).values()) / sum((got | want).values()))
    return best


def test_against_all_windows(spark):
    rng = random.Random(2)
    vocab = [f"{a}{b}é" for a in "abcdefgh" for b in "klmnop"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([1, 3, 4, 5, 6, 15, 30, 57, 57])]
    items += [(50, ""), (51, None), (52, "Solo")]
    docs = []
    for i in range(150):
        body = [rng.choice(vocab) for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(3)):
            part = list(rng.choice(items[5:9])[1].split())
            for _ in range(rng.randrange(4)):
                part[rng.randrange(len(part))] = rng.choice(vocab).upper()
            at = rng.randrange(len(body) + 1)
            body[at:at] = part
        docs.append((i, ", ".join(body)))
    docs += [(200, None), (201, ""), (202, "a solo b solo"), (None, items[6][1]), (None, "clean"), (3, "repeated id, clean text"), (203, items[6][1] * 2), (203, items[6][1] * 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 item_id", "2 similarity")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = op.contaminated(df, bench).collect()
    want = {(d, i): s for d, t in docs for i, x in items if (s := plain(t, x)) >= 0.8}
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert len(got) == len(want) + sum(k[0] == 203 for k in want)
    blocks = op.contaminated(df, bench, max_chars=200).collect()
    assert sorted(map(str, blocks)) == sorted(map(str, got))
    kept = [(r.doc_id, r.text) for r in op.clean(df, bench).collect()]
    bad = {t for _, t in docs if any(plain(t, x) >= 0.8 for _, x in items)}
    assert sorted(kept, key=str) == sorted(((d, t) for d, t in docs if t not in bad), key=str)


def test_blocks_find_every_item_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(0)
    group = op.Group(9, [(i, rng.integers(0, 1 << 62, 9).astype(np.uint64)) for i in range(40)])
    fp = []
    for _ in range(400):
        x = np.unpackbits(group.fp[rng.integers(40)])
        x[rng.choice(64, rng.integers(0, 30), replace=False)] ^= 1
        fp.append(np.packbits(x))
    fp = np.array(fp)
    d = np.bitwise_count(fp[:, None, :] ^ group.fp[None]).sum(axis=2)
    for among in (np.ones(40, dtype=bool), np.arange(40) % 3 == 0):
        got = {(w, i) for ws, its, _ in group.candidates(fp, np.packbits(among)) for w, i in zip(ws.tolist(), its.tolist(), strict=True)}
        assert got == set(zip(*(x.tolist() for x in np.nonzero((d <= op.RADIUS) & among[None])), strict=True))


def test_twenty_thousand_items_of_one_length_and_a_long_text_in_bounded_memory():
    import tracemalloc

    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(3000)]
    start = "what is the right answer to".split()  # in common to all
    items = [(i, " ".join(start + [rng.choice(vocab) for _ in range(24)])) for i in range(20_000)]
    index = op.Index(items)
    body = [rng.choice(vocab) for _ in range(20_000)]
    for k in range(100, 20_000, 400):
        body[k : k + 6] = start
    body[5000:5030] = items[77][1].split()
    tracemalloc.start()
    got = [m[0] for m in index.matches(op.word_hashes([" ".join(body)])[0])]
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()
    assert got == [77]
    assert [m[0] for m in index.matches(op.word_hashes(["x" * 5_000_000 + " " + items[5][1]])[0])] == [5]


def test_radius_loses_almost_nothing_at_the_least_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    lost = n = 0
    for _ in range(2000):
        size = int(rng.integers(20, 400))
        a = rng.integers(0, 1 << 63, size).astype(np.uint64)
        b = a.copy()
        b[: int(size * 0.2 / 1.8)] = rng.integers(0, 1 << 63, int(size * 0.2 / 1.8)).astype(np.uint64)
        assert op.similarity(a, b) >= op.SIMILARITY
        fp = [np.packbits(op._bits(x).sum(axis=0, dtype=np.int64) * 2 > size) for x in (a, b)]
        n, lost = n + 1, lost + (np.bitwise_count(fp[0] ^ fp[1]).sum() > op.RADIUS)
    assert lost == 0


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert op.contaminated(docs, none).collect() == []
    assert op.contaminated(docs.limit(0), none).collect() == []
    assert op.clean(docs, none).count() == 1
    assert op.clean(docs.limit(0), none).collect() == []


def test_clean_keeps_all_columns_and_takes_blocks_of_items(spark):
    items = [(i, f"item number {i} of the benchmark in words {i}") for i in range(4)]
    docs = spark.createDataFrame([(1, items[2][1], [1], "r"), (1, "fine", None, None), (None, None, [2], "s")], "doc_id long, text string, row array<int>, item_id string")
    kept = op.clean(docs, spark.createDataFrame(items, "item_id long, text string"), max_chars=50)
    assert kept.schema == docs.schema
    assert sorted((r.text is None, r.row, r.item_id) for r in kept.collect()) == [(False, None, None), (True, [2], "s")]
