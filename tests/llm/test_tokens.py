import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from framewright.llm import packing, simple8b, tokens

ODD = ["", " ", "\n", "a  b", "a   b", "a\n \nb", " \n x", "a \nb\n c", "don't, it's", "x\x1cy z", "a\x00 b", "É é İstanbul ǅ", "<|endoftext|> a<|endoftext|>", "1,234.5 $%&", "é a b 　c", "ﬁ é, ü.", "x. y! z)", "a  b   c", "日本語 テスト", "😀, 😀😀."]


def texts(n, seed=0):
    rng = random.Random(seed)
    bits = ["the", "Éa", "th", "12", "'s", "n't", "!!", "###", ",", ".", "\n", "  ", " ", " ", " ", "\t", " ", "|", "\x1f", "-"]
    return ODD + ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("limit", [20, 10**6])
@pytest.mark.parametrize("as_text", [False, True])
def test_ids_equal_the_library(name, limit, as_text):
    path = str(public_tokenizers.path(name))
    enc, plain = tokens.Encoder(path, as_text), Tokenizer.from_file(path)
    enc.limit = limit
    if as_text:
        plain.encode_special_tokens = True
    all_ = texts(1500) + thue_morse()
    for i in range(0, len(all_), 100):
        part = all_[i : i + 100]
        want = [e.ids for e in plain.encode_batch(part, add_special_tokens=False)]
        assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(part)] == want


def thue_morse():
    """Words with equal polynomial hashes modulo 2**64 whatever the base, and special tokens among them."""
    out = []
    for n in (8, 16, 64, 1024, 2048):
        bits = [bin(i).count("1") % 2 for i in range(n)]
        out += ["".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)]
    return [*out, " ".join(out), "hello <|endoftext|> world", "x<|startoftext|>y <|ENDOFTEXT|>", "<|endoftext| >"]


def test_parts_with_equal_hashes_are_told_apart(monkeypatch):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(tokens, "_ODD", np.uint64(0))  # only the last eight bytes of a longer part are hashed
    enc, plain = tokens.Encoder(path), Tokenizer.from_file(path)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.choice([8, 12, 16, 24, 60, 64, 70])))
    some = [word() for _ in range(40)]
    all_ = [" ".join(w[:-8] + "samesame" for w in rng.choices(some, k=30)) for _ in range(40)]
    for i in range(0, 40, 10):
        want = [e.ids for e in plain.encode_batch(all_[i : i + 10], add_special_tokens=False)]
        assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(all_[i : i + 10])] == want


def rows():
    return [(i, t) for i, t in enumerate(texts(200))] + [(None, "null id"), (500, None), (501, "same"), (501, "same"), (502, "long " * 12000)]


def test_packing(spark):
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.createDataFrame(rows(), "doc_id long, text string").selectExpr("*", "1 piece", "2 offset")
    got = packing.packed(docs, path, shard=60).collect()
    plain = Tokenizer.from_file(path)
    want = []
    for i, t in rows():
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            p = ids[k : k + 4096]
            want.append((i, k // 4096, k, len(p), zlib.crc32(np.array(p, "<u4").tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in by.values():
        end = 0
        for o, n in sorted(p):
            assert o == end
            end += n
        assert end <= 4096
    assert packing.packed(docs.limit(0), path).collect() == []


def test_local_search_empties_bins():
    got = packing.Search([[0, 1], [2, 3], [4]], [6, 2, 5, 3, 4], 10).run()  # only exchanges help
    assert len(got) == 2 and sorted(i for b in got for i in b) == list(range(5))
    rng = random.Random(4)
    sizes = [rng.randrange(300, 2000) for _ in range(1500)]
    first = [[i, i + 1] for i in range(0, 1500, 2)]  # far from packed
    got = packing.Search(first, sizes, 4096).run()
    assert len(got) <= 1.1 * sum(sizes) / 4096 and max(sum(sizes[i] for i in b) for b in got) <= 4096
    assert sorted(i for b in got for i in b) == list(range(1500))


@pytest.mark.parametrize("top", [1, 2, 10, 300, 32767, 32769, 50257, 1 << 20, (1 << 32) - 1])
def test_simple8b_round_trip(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 239, 32768, 32769, 100_000):
        x = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
        x[: n // 3] = 0
        x[n // 2 :: 7] = top - 1
        s = simple8b.Segment(simple8b.encode_segment([1, None], [x[: n // 2].tobytes(), x[n // 2 :].tobytes()]))
        assert np.array_equal(s.ids(), x) and s.doc_ids == [1, None]
        if n > 32768:
            assert np.array_equal(s.block(1), x[32768:65536])


def test_files(spark):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame(rows(), "doc_id long, text string").selectExpr("*", "1 h", "2 part").repartition(5)
    got = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in simple8b.round_trip(docs, path, 2).collect()}
    plain = Tokenizer.from_file(path)
    start, want = 0, {}
    for i, t in sorted(rows(), key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        want[i, start] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want
    assert simple8b.round_trip(docs.limit(0), path).collect() == []
