import random
import re
from collections import Counter

import pytest

from framewright.llm import collocations as op


def plain(docs, support, subsumed, best):
    """The contract, word by word, for (text, lang) rows."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f = Counter()
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f["und" if lang is None else lang, tuple(words[i : i + m])] += 1
    n = Counter()
    for (lang, p), c in f.items():
        n[lang] += c * (len(p) == 1)
    able, rows = {k: c for k, c in f.items() if len(k[1]) > 1 and c >= support}, {}
    for (lang, p), a in able.items():
        cuts = [(op.SCALE * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = any(len(q) > len(p) and g == lang and 100 * c >= subsumed * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (g, q), c in able.items())
        if not inside:
            rows.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, le, r, n[lang], -s) for lang, some in rows.items() for i, (s, a, p, le, r) in enumerate(sorted(some)[:best], 1))


def rows_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def texts(seed, n):
    rng = random.Random(seed)
    words = ["a", "b", "É", "é", "C", "c", "dd", "a\x01", "e\x00f", "the", "of", "😀", "\x0b", "x,y", "z.", "A;", "\t", "  "]
    return [(" ".join(rng.choice(words[: rng.randrange(3, len(words))]) for _ in range(rng.randrange(60))), rng.choice(["en", "en", "en", "de", None, "", "e n"])) for _ in range(n)]


@pytest.fixture
def small(monkeypatch):
    for name, value in (("BLOCK", 64), ("SHARD_TOKENS", 150), ("RANGE_WINDOWS", 40), ("MERGE_WINDOWS", 100), ("OPEN_SHARDS", 3)):
        monkeypatch.setattr(op, name, value)


def test_a_texts_blocks_give_the_windows_of_the_whole(small):
    for text, _ in texts(3, 200):
        shard = op.Shard()
        shard.add(text)
        run = shard.run()
        got = {tuple(run.words[i - 1] for i in w if i): c for w, c in zip(run.rows.T.tolist(), run.counts.tolist(), strict=True)}
        want = Counter()
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", text.encode().lower()):
            words = re.findall(rb"[^\x20\x09]+", piece)
            want.update(tuple(words[i : i + 4]) for i in range(len(words)))
        assert got == want
        back = op.Run.unpacked(*run.piece(0, len(run.counts)))
        assert back.words == run.words and (back.rows == run.rows).all() and (back.counts == run.counts).all()


def test_any_boundaries_give_the_same_phrases(small):
    rng = random.Random(9)
    shards = []
    for s in range(4):
        shard = op.Shard()
        for text, _ in texts(20 + s, 60):
            shard.add(text)
        shards.append(shard.run())
    every = sorted({tuple(r.words[i - 1] for i in w if i) for r in shards for w in r.rows.T.tolist()})
    whole = None
    for cuts in (0, 1, 7, 40, len(every)):
        bounds = sorted({(b"en", w) for w in (rng.sample(every, cuts) if cuts < len(every) else every)} | {(b"de", (b"a",)), (b"fr", (b"zz", b"a"))} if cuts else set())
        held, seeds = {}, {}
        for run in shards:
            for number, _, words, windows, more in op.cut_run("en", run, bounds):
                one = op.Run.unpacked(words, windows)
                held[number] = op.Run.merged([held[number], one]) if number in held else one
                for p, n in op._seeds(more).items():
                    seeds.setdefault(number, Counter())[p] += n
        got = sorted(r for number, run in held.items() for r in op.nodes("en", number, run, seeds.get(number, {}), bounds, 3) if r[1])
        assert len(got) == len({r[2] for r in got})
        whole = whole or got
        assert got == whole


def test_collocations_equal_plain_python(spark, small):
    docs = texts(5, 400) + [(None, "en"), ("", None), ("the of a " * 3000, "en"), ("w" * 500 + " x " + "w" * 500, "de")]
    df = spark.createDataFrame(docs, "text string, lang string").selectExpr("*", "1 AS m", "2 AS phrase", "3 AS `range`").repartition(5)
    for support, best in ((4, 7), (30, 2000)):
        got = rows_of(op.collocations(df, support=support, best=best))
        assert got == plain(docs, support, op.SUBSUMED, best) and got


def test_no_table_or_no_frequent_phrase_gives_no_row(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert op.collocations(empty).collect() == []
    assert op.collocations(spark.createDataFrame([("one two three", "en"), (None, None)], "text string, lang string")).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    df = spark.createDataFrame([("x y", 2, big, [big], [big]), ("x y z", 3, big - 1, [big, big], [big, big])], "phrase string, m int, f long, lefts array<long>, rights array<long>")
    got = [r.c for r in df.select(op._best_cut(df.f, df.m).alias("c")).collect()]
    assert [(c.score, c.k) for c in got] == [(op.SCALE * big // (2 * big), 1), (op.SCALE * (big - 1) // (2 * big), 1)]


def test_windows_of_many_words_are_ordered_by_pairs():
    import numpy as np

    rng = np.random.default_rng(4)
    rows = rng.integers(0, 70_000, size=(4, 3000)).astype(np.int32)
    rows = np.concatenate([rows, rows[:, :500], rows[:, :200]], axis=1)
    counts = rng.integers(1, 9, size=rows.shape[1])
    want, ones = Counter(), Counter()
    for w, c in zip(map(tuple, rows.T.tolist()), counts.tolist(), strict=True):
        want[w] += c
        ones[w] += 1
    for given, expect in ((counts, want), (None, ones)):
        for words in (70_000, (1 << 27) - 1):
            got, n = op._counted(rows, given, words)
            assert list(zip(map(tuple, got.T.tolist()), n.tolist(), strict=True)) == sorted(expect.items())
