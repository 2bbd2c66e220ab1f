import random

from framewright.llm import licences as op


def plain(text):
    w = op.words(text)
    places = [(i, label) for p, label in op.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_places_equal_plain_search(spark):
    rng = random.Random(4)
    bits = "under the MIT License apache version 2 cc by nc cc-by-nc by. É x Under, THE mit_license 2.0 | \n".split(" ")
    texts = [rng.choice([" ", ", "]).join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += [None, "", "under the mit license " * 5000, "Apache License, Version 2.0", "CC BY-NC 4.0", "under the mit licenseé"]
    docs = spark.createDataFrame([*enumerate(texts), (None, "cc by nc")], "doc_id long, text string").selectExpr("*", "1 labels")
    got = {r.doc_id: r for r in op.scanned(docs).collect()}
    for i, t in [*enumerate(texts), (None, "cc by nc")]:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert op.scanned(docs.limit(0)).collect() == []


def test_matching_statistics_equal_brute_force():
    rng = random.Random(6)
    seqs = [[rng.randrange(3) for _ in range(rng.randrange(1, 14))] for _ in range(6)]
    a = op.Automaton(seqs)
    places = lambda x: {(k, i + len(x)) for k, s in enumerate(seqs) for i in range(len(s) - len(x) + 1) if s[i : i + len(x)] == x}
    for _ in range(200):
        text = [rng.randrange(4) for _ in range(20)]
        for i, (state, n) in enumerate(a.statistics(text), 1):
            want = max(k for k in range(i + 1) if k == 0 or places(text[i - k : i]))
            assert n == want
            if n:
                assert a.ends[state] == places(text[i - n : i])


def test_templates_are_found_whole_cut_and_edited(spark):
    filler = "lorem ipsum dolor sit amet "
    long = dict((x, t) for x, t in op.TEMPLATES if len(t) > 300)
    edited = {x: t.replace("Software", "Program", 1).replace("License", "Licence", 1).replace("source", "origin", 1) for x, t in long.items()}
    half = {x: " ".join(t.split()[: len(t.split()) // 2]) for x, t in long.items()}
    rows = [(i, filler * 3 + t + "\n" + filler * 3) for i, t in enumerate([*long.values(), *edited.values(), *half.values(), "This work is licensed under the GNU General Public License, version 3.", "it is the end of the day and by the way"])]
    got = {r.doc_id: r for r in op.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(long)
    for i, x in enumerate(long):
        assert x in got[i].labels.split(",") and got[i].score == 1.0
        assert f"{x}:15:" in got[i].licence_spans
        assert x in got[n + i].labels.split(",")
        assert 0.3 < got[2 * n + i].score or got[2 * n + i].n_base
    assert got[3 * n].labels == "gpl-3" and got[3 * n].n_base == 0
    assert got[3 * n + 1].labels == "" and got[3 * n + 1].score < 0.75


def test_chain_takes_the_best_order():
    assert op.best_chain([(5, 5, 5), (12, 15, 6), (20, 10, 5), (30, 20, 5)], 20)[0] == 16
    assert op.best_chain([(5, 5, 5), (60, 10, 5)], 10) == (5, 0, 5)
    assert op.best_chain([(10, 10, 10), (21, 19, 10)], 19) == (19, 0, 21)  # one template word in both


def test_a_doubled_word_in_the_middle_loses_no_licence(spark):
    long = [(x, t.split()) for x, t in op.TEMPLATES if len(t) > 300]
    rows = [(i, " ".join([*w[: len(w) // 2], w[len(w) // 2], *w[len(w) // 2 :]])) for i, (_, w) in enumerate(long)]
    got = {r.doc_id: r for r in op.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (x, _) in enumerate(long):
        assert x in got[i].labels.split(",") and got[i].score > 0.98
