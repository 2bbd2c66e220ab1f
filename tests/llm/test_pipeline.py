import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framewright.llm import quality

from . import test_decontaminate, test_pii, test_simhash_dedup


def by_hand(spark, sf, rows, bench):
    """Ids and texts after each of the first four stages, and the last one's pieces, by plain Python from the trained weights on."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    w = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), labels.where(~quality.held_out()))
    score = lambda f: 1 / (1 + np.exp(-(sum(float(w[i]) for i in f) * 8 / max(1, len(f)) + float(w[-1]))))
    out = [dict((i, t) for (i, t, *_), f in zip(rows, quality.features([r[1] for r in rows]), strict=True) if score(f) >= quality.THRESHOLD)]
    near = test_simhash_dedup
    fps, sets = {i: near.plain_fingerprint(t) for i, t in out[0].items()}, {i: near.plain_set(t) for i, t in out[0].items()}
    kept = set(near.plain_classes(list(out[0]), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3 or near.plain_similarity(sets[a], sets[b]) >= 0.8).values())
    out.append({i: t for i, t in out[0].items() if i in kept})
    out.append({i: t for i, t in out[1].items() if all(test_decontaminate.plain(t, x) < 0.8 for _, x in bench)})
    out.append({})
    for i, t in out[2].items():  # no term here discloses anything
        for kind, s, e in sorted(test_pii.plain(t), key=lambda x: -x[1]):
            t = f"{t[:s]}[{kind.upper()}]{t[e:]}"
        out[3][i] = t
    plain, pieces = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json"))), []
    for i, t in out[3].items():
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        pieces += [(i, k // 4096, k, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k in range(0, len(ids), 4096) for p in [ids[k : k + 4096]]]
    return out, pieces


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(9)
    vocab = ["write", "to", "now"] + [a + b for a in "bcdfghklmn" for b in ("ala", "ere", "ono", "umi", "ist", "end", "ork")]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    bench = [(i, text(20)) for i in range(3)]
    docs = [(i, text(rng.randrange(60, 200))) for i in range(120)]
    junk = [(200 + i, " ".join(w + "###" for w in text(60).split())) for i in range(40)]
    copies = [(300 + i, docs[i][1]) for i in range(10)]
    leaks = [(400 + i, text(40) + " " + bench[i % 3][1] + " " + text(30)) for i in range(6)]
    private = [(500 + i, text(50) + f" write to u{i}@mail.org now") for i in range(8)]
    odd = [(600, None), (601, "")]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs + junk + copies + leaks + private + odd]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in docs] + [(i, 0, 0) for i, _ in junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    at, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = at.columns
        at = stage(spark, at, sf)
        if name != "packing":
            assert at.columns == before
            at.write.parquet(f"{sf}/{name}")
            at = spark.read.parquet(f"{sf}/{name}")
            out[name] = {r.doc_id: r for r in at.collect()}
    junk_ids, ids = {i for i, _ in junk}, lambda n: set(out[n])
    assert not ids("quality") & junk_ids and ids("quality") >= {i for i, _ in docs + copies + leaks + private}
    assert ids("quality") - ids("near_duplicates") - {601} == {i for i, _ in copies}
    assert ids("near_duplicates") - ids("decontamination") == {i for i, _ in leaks}
    assert ids("pii") == ids("decontamination")
    for i, t in docs + private:
        want = t if i < 500 else t.rsplit(" ", 2)[0] + " [EMAIL] now"
        assert out["pii"][i].text == want and out["pii"][i].n_chars == len(want)
    want, pieces = by_hand(spark, sf, rows, bench)
    for (name, _), texts in zip(corpus_pipeline.STAGES[:4], want, strict=True):
        assert {i: r.text for i, r in out[name].items()} == texts
    packed = corpus_pipeline.run(spark, sf)
    assert sorted(tuple(r)[:5] for r in packed.collect()) == sorted(pieces)
    assert {r.doc_id for r in packed.collect()} == ids("pii")
    assert packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 4096


def test_empty_tables_null_and_repeated_ids(spark, tmp_path):
    sf, empty = f"{tmp_path}/some", f"{tmp_path}/none"
    text = "a plain text of some words that stands here " * 3
    rows = [(1, text, "x"), (1, text, "x"), (1, "another text of id one, quite unlike the first in all that it says", "y"), (None, "null id mail a@b.org", "z"), (None, None, "z"), (2, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "an item that no document here holds at all")], "item_id long, text string")
    for at, part in ((sf, docs), (empty, docs.limit(0))):
        part.write.parquet(f"{at}/documents.parquet")
        (labels if at == sf else labels.limit(0)).write.parquet(f"{at}/labels.parquet")
        (bench if at == sf else bench.limit(0)).write.parquet(f"{at}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).collect() == []
    at = docs
    for name, stage in corpus_pipeline.STAGES[1:4]:  # all but the classifier, which one label can't train
        at = stage(spark, at, sf)
        assert at.columns == docs.columns
    got = sorted(((r.doc_id or 0, r.text or "", r._row or "") for r in at.collect()), key=str)
    assert got == sorted([(1, text, "x"), (1, rows[2][1], "y"), (0, "null id mail [EMAIL]", "z"), (0, "", "z"), (2, "", "")], key=str)
    assert corpus_pipeline.packing_stage(spark, at, sf).count() == 5


def test_the_quality_stage_keeps_columns_of_its_own_names(spark, tmp_path):
    rows = [(i, f"some plain words number {i} and more of them", f"orig{i}", i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _score string, score long")
    spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.quality_stage(spark, docs, str(tmp_path)).collect()
    assert got and got[0].asDict().keys() == {"doc_id", "text", "_score", "score"} and all(r._score == f"orig{r.doc_id}" and r.score == r.doc_id for r in got)
