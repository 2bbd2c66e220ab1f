import random
from itertools import combinations

import numpy as np
import xxhash

from framewright.llm import simhash_dedup as op


def plain_fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def plain_components(fps):
    return plain_classes(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)


def plain_classes(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(ids, 2):
        if linked(a, b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in ids}


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"W{i}é" for i in range(300)]
    texts = {1: None, 2: "", 3: " \t\n", 4: "one", 5: "One two", 6: "a b c d"}
    base = [rng.choice(words) for _ in range(400)]
    for i in range(10, 60):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(400)] = rng.choice(words)
        texts[i] = " ".join(copy)
    for i in range(100, 140):
        texts[i] = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 50)))
    rows = [(k, v, "x") for k, v in texts.items()] + [(10, texts[10], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = op.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = {k: plain_fingerprint(v) for k, v in texts.items()}
    want = plain_components(fps)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(k, f"{fps[k]:016x}", want[k]) for k in texts}
    kept = op.deduplicated(docs)
    assert kept.columns == docs.columns
    grams = {k: plain_set(v) for k, v in texts.items()}
    near = plain_classes(list(texts), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3 or plain_similarity(grams[a], grams[b]) >= 0.8)
    assert {r.doc_id for r in kept.collect()} == set(near.values())


def test_fingerprints_of_long_texts_and_other_widths():
    rng = random.Random(2)
    long = " ".join(str(rng.randrange(10**9)) for _ in range(400_000))  # several blocks
    for text in (long, "x" * 3_000_000, "a " * 700_000):
        assert op.fingerprint(text) == plain_fingerprint(text)
    assert op.fingerprint("b a", 1) == op.fingerprint("a b", 1) and op.fingerprint("a b", 5) == plain_fingerprint("a b")


def test_links_of_large_buckets_connect_like_all_pairs(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(1 << 62))
    fps = {centre}
    while len(fps) < 900:
        x = centre
        for b in rng.choice(64, rng.integers(1, 6), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps |= {int(x) for x in rng.integers(0, 1 << 62, 300)}
    want = plain_components({f: f for f in fps})
    signed = {np.uint64(f).astype(np.int64).item(): f for f in fps}
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    links = [(signed[r.a], signed[r.b]) for r in op.linked(df).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    root = {f: f for f in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert {f: find(f) for f in fps} == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op.near_duplicates(docs).collect() == []
    assert op.deduplicated(docs).collect() == []


def test_edited_copies_of_all_sizes_are_found_and_others_left(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(4000)]
    rows, groups = [], {}
    for g in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([30, 120, 500]))]
        for k in range(rng.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(len(base) // 60 if k else 0):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            groups[len(rows)] = g
            rows.append((len(rows), " ".join(copy)))
    shared = " ".join(rng.choice(vocab) for _ in range(60))
    for _ in range(60):  # a passage in common is no copy
        groups[len(rows)] = len(rows) + 1000
        rows.append((len(rows), shared + " " + " ".join(rng.choice(vocab) for _ in range(120))))
    rows += [(None, rows[0][1]), (None, "alone"), (0, "an unrelated text of a repeated id"), (7000, "one text of a repeated id"), (7000, "another text of it")]
    groups[7000] = 7000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.doc_id for r in op.deduplicated(docs).collect()]
    assert got.count(None) == 2
    assert got.count(7000) == 2 and got.count(0) == 2
    kept = {i for i in got if i is not None}
    firsts = {min(i for i in groups if groups[i] == g) for g in set(groups.values())}
    assert firsts <= kept and len(kept - firsts) <= 2


def edited_copies(n, words, edits, seed):
    rng = random.Random(seed)
    base = [f"b{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for at in rng.sample(range(words), edits):
            copy[at] = f"e{rng.randrange(10**9)}"
        out.append(" ".join(copy))
    return out


def test_large_groups_of_edited_copies_keep_no_pair_of_one_bucket_unlinked(spark, monkeypatch):
    monkeypatch.setattr(op, "TILE_TEXTS", 64)  # many tiles
    texts = edited_copies(500, 300, 4, 3) + edited_copies(40, 80, 1, 4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = list(op.shingle_sets(texts))
    samples = np.array([op.sample_fingerprints(f) for f in sets])
    fps = [plain_fingerprint(t) for t in texts]

    def linked(i, j):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            return True
        if not (samples[i] == samples[j]).any():
            return False
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return both / (len(sets[i]) + len(sets[j]) - both) >= 0.8

    want = set(plain_classes(list(range(len(texts))), linked).values())
    assert {r.doc_id for r in op.deduplicated(docs).collect()} == want


def test_pairs_among_relatives_that_are_not_similar_are_all_found(spark):
    """Families of texts whose pairs alone reach 0.8, as 0.81 to 0.83; the rest of a family stays below."""
    rng = random.Random(12)
    texts = []
    for f in range(4):
        base = [f"b{f}x{rng.randrange(10**6)}" for _ in range(400)]
        for _ in range(75):
            free = list(range(0, 400, 7))
            rng.shuffle(free)
            same, own = free[:2], (free[2:6], free[6:10])
            mark = {i: f"c{rng.randrange(10**9)}" for i in same}
            for mine in own:
                copy = list(base)
                for i in same:
                    copy[i] = mark[i]
                for i in mine:
                    copy[i] = f"e{rng.randrange(10**9)}"
                texts.append(" ".join(copy))
    sets = list(op.shingle_sets(texts))
    fps = [op.fingerprint(t) for t in texts]

    def linked(i, j):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            return True
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return both / (len(sets[i]) + len(sets[j]) - both) >= 0.8

    assert all(linked(i, i + 1) for i in range(0, 600, 2))
    want = {}
    for f in range(4):
        want |= plain_classes(list(range(150 * f, 150 * f + 150)), linked)
    got = {r.doc_id for r in op.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == set(want.values())


def test_rows_of_one_id_and_text_leave_one(spark):
    docs = spark.createDataFrame([(3, "a b c", "x"), (3, "a b c", "y"), (2, "a b c", "z"), (2, "a b c", "z"), (None, "a b c", "n")], "doc_id long, text string, _row string")
    got = op.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or -1, r._row) for r in got.collect()) == [(-1, "n"), (2, "z")]


def test_links_in_a_tile_are_similar_and_connect_like_all_pairs():
    import pyarrow as pa

    texts = edited_copies(120, 100, 2, 8) + [f"other {i} text of its own words" for i in range(5)]
    sets = [plain_set(t) for t in texts]
    root = [i // 2 if i < 20 else i for i in range(len(texts))]
    shingles = [f.view(np.int64).tolist() for f in op.shingle_sets(texts)]
    got = op.tile_links(pa.table({"node": list(range(len(texts))), "root": root, "shingles": pa.array(shingles, pa.list_(pa.int64()))}))
    links = set(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True))
    assert all(root[a] != root[b] and plain_similarity(sets[a], sets[b]) >= 0.8 for a, b in links)
    near = lambda a, b: root[a] != root[b] and plain_similarity(sets[a], sets[b]) >= 0.8
    ids = range(len(texts))
    assert plain_classes(ids, near) == plain_classes(ids, lambda a, b: (a, b) in links or (b, a) in links)


def test_sampled_fingerprints_of_long_sets_do_not_depend_on_blocks():
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 100_000).astype(np.uint64))
    h = op.mix(x[None] ^ op._ORDERS[:, None])
    least = np.sort(h, axis=1)[:, : op.SAMPLE]
    bits = np.unpackbits(least.view(np.uint8).reshape(op.SAMPLES, -1, 8), axis=2).sum(axis=1) * 2 > op.SAMPLE
    assert np.array_equal(op.sample_fingerprints(x), np.packbits(bits, axis=1).view(np.int64).ravel())
