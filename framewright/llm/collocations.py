"""Operator 11: phrase collocations from depth-limited count tries, merged by prefix range.

A position of a piece opens a window: its word and the up to three words after it within the piece. A
shard's trie of depth four is its different windows in order with their counts: a node, that is a phrase, is
a prefix of windows, and its count is the sum of theirs. Shards of about a million words each are sorted,
cut at the boundaries of prefix ranges and serialised (the words once, then columns of word numbers); a range's
runs are merged many at a time, once their windows are half as many as what was merged before, so a window is merged
as often as the logarithm of its range's size. The walk over a merged range gives each phrase that is frequent enough its count and, from the nodes
above it, its left parts. A boundary may fall into the middle of a node: each shard therefore sends both of
its neighbour ranges what it has of that node elsewhere (`seeds`), and the range in which the node starts
reports it. Boundaries are full windows, quantiles of a bounded sample of windows, so a frequent word or
pair of words takes as many ranges as it needs; they have no part in any result.

Right parts follow the suffix link, the phrase without its first word: it is a frequent phrase too, and its
own right parts are the rest of the phrase's, so phrases of one length join those of the length before.

Nulls and rows: a null text is empty, a null lang is `und`; repeated rows count each; texts and words of
any length are taken a megabyte at a time; equal scores fall to the smallest cut, equal ranks by count and
then by the phrase's bytes; an empty table, or one without frequent phrases, gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, in_order, partitions_for, release, slices, written

DEPTH = 4
SUPPORT, SUBSUMED, BEST = 30, 80, 2000
SCALE = 2_000_000
#: Bytes at which a piece ends.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_MARK = b"\xff"  # no byte of any text
_TABLE = bytes(_MARK[0] if c in BREAKS else 0x20 if c == 0x09 else c for c in range(256))
BLOCK = 1 << 20
#: A shard is closed beyond so many tokens or bytes.
SHARD_TOKENS, SHARD_BYTES = 1 << 21, 16 << 20
#: Languages whose shards a task fills side by side.
OPEN_SHARDS = 64
#: Sampled texts and windows of each, for the boundaries; windows of a range, roughly; the most ranges.
SAMPLE_TEXTS, SAMPLE_WINDOWS, RANGE_WINDOWS, MAX_RANGES = 4096, 32, 4 << 20, 20_000
#: Windows that wait for a merge, or half as many as have been merged.
MERGE_WINDOWS = 1 << 20
RUN = "range int, lang string, words binary, windows binary, seeds binary"
NODES = "lang string, m int, phrase string, f long, lefts array<long>"


class _Ids(dict):
    """Numbers of words in order of appearance; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({_MARK: 0})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def tokens(text: str) -> Iterator[tuple[list[bytes], bool]]:
    """(words and marks, whether more follows) of a text, about a megabyte at a time."""
    data = text.encode().lower().translate(_TABLE)
    at = 0
    while at < len(data) or not at:
        end = at + BLOCK
        if end < len(data):
            cut = data.rfind(b" ", at, end)
            cut = data.find(b" ", end) if cut < 0 else cut
            end = len(data) if cut < 0 else cut + 1
        yield [w for w in data[at:end].replace(_MARK, b" \xff ").split(b" ") if w], end < len(data)
        at = max(end, 1)


class Shard:
    """The windows of some texts of one language."""

    def __init__(self):
        self.ids, self.parts, self.open, self.size, self.bytes = _Ids(), [], [], 0, 0

    def add(self, text: str) -> None:
        held: list[int] = []
        for words, more in tokens(text):
            got = held + list(map(self.ids.__getitem__, words))
            n = len(got)
            if more:  # the last windows open in the next block
                held = got[max(0, n - DEPTH + 1) :]
                n -= len(held)
            # a block's last words close windows that open before them, and open none
            self.parts.append(np.array([*got, 0], dtype=np.int32))
            opens = np.ones(len(got) + 1, dtype=bool)
            opens[n:] = False
            self.open.append(opens)
            self.size += len(got)
        self.bytes += len(text)

    def full(self) -> bool:
        return self.size >= SHARD_TOKENS or self.bytes >= SHARD_BYTES

    def run(self) -> "Run":
        flat = np.concatenate([*self.parts, np.zeros(DEPTH, dtype=np.int32)])
        opens = np.concatenate([*self.open, np.zeros(DEPTH, dtype=bool)])
        words = sorted(w for w in self.ids if w is not _MARK and self.ids[w])
        rank = np.zeros(len(self.ids), dtype=np.int32)
        rank[[self.ids[w] for w in words]] = np.arange(1, len(words) + 1)
        flat = rank[flat]
        at = np.flatnonzero(opens & (flat > 0))
        rows = np.empty((DEPTH, len(at)), dtype=np.int32)
        rows[0] = flat[at]
        for k in range(1, DEPTH):
            rows[k] = np.where(rows[k - 1] > 0, flat[at + k], 0)
        return Run(words, *_counted(rows, None, len(words)))


def _counted(rows: np.ndarray, counts: np.ndarray | None, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Different windows (columns of rows) in order and the sums of their counts (none: one each).

    A window is one 64-bit number, of its four words or of the place of its first two among all such pairs and
    the other two, so that one sort of numbers orders windows.
    """
    n, b = rows.shape[1], max(1, int(words).bit_length())
    if not n:
        return rows, np.zeros(0, dtype=np.int64)
    two = lambda k: rows[k].astype(np.uint64) << np.uint64(b) | rows[k + 1].astype(np.uint64)
    first, mask = two(0), np.uint64((1 << b) - 1)
    pairs = None
    if DEPTH * b > 64:
        pairs, first = np.unique(first, return_inverse=True)
        first = first.astype(np.uint64)
        if 2 * b + len(pairs).bit_length() > 64:  # more words than such numbers hold: sorted word by word
            order = np.lexsort(rows[::-1])
            rows, counts = rows[:, order], np.ones(n, dtype=np.int64) if counts is None else counts[order]
            new = np.flatnonzero(np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)]))
            return rows[:, new], np.add.reduceat(counts, new)
    key = first << np.uint64(2 * b) | two(2)
    if counts is None:
        key = np.sort(key)
    else:
        order = np.argsort(key)
        key, counts = key[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    counts = np.diff(np.append(new, n)) if counts is None else np.add.reduceat(counts, new)
    key = key[new]
    first = key >> np.uint64(2 * b)
    first = first if pairs is None else pairs[first]
    out = np.empty((DEPTH, len(new)), dtype=np.int32)
    out[0], out[1], out[2], out[3] = first >> np.uint64(b), first & mask, key >> np.uint64(b) & mask, key & mask
    return out, counts


class Run:
    """Sorted different windows with counts; word numbers start at 1, 0 fills windows that a piece's end cuts."""

    def __init__(self, words: list[bytes], rows: np.ndarray, counts: np.ndarray):
        self.words, self.rows, self.counts = words, rows, counts

    def place(self, window: tuple[bytes, ...]) -> tuple[int, list[tuple[int, int]]]:
        """Where a window stands or would stand, and the stretch of each of its proper prefixes."""
        lo, hi, found = 0, len(self.counts), []
        for k in range(DEPTH):
            if k >= len(window):
                break  # shorter windows stand before longer ones of the same prefix
            i = bisect.bisect_left(self.words, window[k])
            known = i < len(self.words) and self.words[i] == window[k]
            column = self.rows[k, lo:hi]
            lo, hi = lo + int(np.searchsorted(column, i + 1, "left")), lo + int(np.searchsorted(column, i + 1, "right" if known else "left"))
            if k < DEPTH - 1:
                found.append((lo, hi))
            if lo == hi:
                break
        return lo, found

    def piece(self, lo: int, hi: int) -> tuple[bytes, bytes]:
        """Words and windows of a stretch, packed."""
        rows = self.rows[:, lo:hi]
        used, inverse = np.unique(rows, return_inverse=True)
        if not len(used) or used[0]:
            used, inverse = np.concatenate([[0], used]), inverse + 1
        kind = np.uint16 if len(used) <= 1 << 16 else np.uint32
        words = b" ".join(self.words[i - 1] for i in used[1:].tolist())
        head = np.array([hi - lo, np.dtype(kind).itemsize], dtype=np.int64).tobytes()
        counts = self.counts[lo:hi]
        body = head + inverse.reshape(rows.shape).astype(kind).tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].tobytes()
        return _packed(words), _packed(body)

    @staticmethod
    def unpacked(words: bytes, windows: bytes) -> "Run":
        words, body = _unpacked(words), _unpacked(windows)
        n, width = np.frombuffer(body, dtype=np.int64, count=2).tolist()
        rows = np.frombuffer(body, dtype=np.uint16 if width == 2 else np.uint32, count=DEPTH * n, offset=16).reshape(DEPTH, n).astype(np.int32)
        at = 16 + DEPTH * n * width
        counts = np.frombuffer(body, dtype=np.uint8, count=n, offset=at).astype(np.int64)
        counts[counts == 255] = np.frombuffer(body[at + n :], dtype=np.int64)
        return Run(words.split(b" ") if words else [], rows, counts)

    @staticmethod
    def merged(runs: list["Run"]) -> "Run":
        """One run of many: their words once, their windows in one order."""
        if len(runs) == 1:
            return runs[0]
        words = sorted({w for run in runs for w in run.words})
        at = {w: i for i, w in enumerate(words, 1)}
        counts = np.concatenate([run.counts for run in runs])
        rows, s = np.empty((DEPTH, len(counts)), dtype=np.int32), 0
        for run in runs:
            number = np.array([0, *map(at.__getitem__, run.words)], dtype=np.int32)
            np.take(number, run.rows, out=rows[:, s : s + len(run.counts)])
            s += len(run.counts)
        return Run(words, *_counted(rows, counts, len(words)))


def _packed(body: bytes) -> bytes:
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _unpacked(body: bytes) -> bytes:
    return pa.decompress(body[8:], int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True)


Bounds = list[tuple[bytes, tuple[bytes, ...]]]


def cut_run(lang: str, run: Run, bounds: Bounds) -> Iterator[tuple]:
    """Rows of RUN: the run's stretch of each range it reaches, and its counts of the ranges' boundary nodes that lie elsewhere."""
    own = lang.encode()
    first, last = bisect.bisect_left(bounds, (own,)), bisect.bisect_left(bounds, (own + b"\x00",))
    mine = [w for _, w in bounds[first:last]]  # range `first` ends at mine[0]
    places = [run.place(w) for w in mine]
    edges = [0, *(p for p, _ in places), len(run.counts)]
    total = np.concatenate([[0], np.cumsum(run.counts)])
    for j in range(len(edges) - 1):
        lo, hi = edges[j], edges[j + 1]
        seeds = {}
        for b in (j - 1, j):
            if 0 <= b < len(mine):
                for k, (s, e) in enumerate(places[b][1], 1):
                    inside = max(0, min(e, hi) - max(s, lo))
                    if e - s > inside:
                        a, z = max(s, lo), max(max(s, lo), min(e, hi))
                        seeds[mine[b][:k]] = int(total[e] - total[s] - (total[z] - total[a]))
        if hi > lo or seeds:
            words, windows = run.piece(lo, hi)
            sizes = np.array([len(seeds), *(x for p, n in seeds.items() for x in (n, len(p)))], dtype=np.int64).tobytes()
            flat = sizes + b" ".join(w for p in seeds for w in p) if seeds else b""
            yield first + j, lang, words, windows, _packed(flat)


def _seeds(body: bytes) -> dict[tuple[bytes, ...], int]:
    flat = _unpacked(body)
    if not flat:
        return {}
    n = int(np.frombuffer(flat, dtype=np.int64, count=1)[0])
    sizes = np.frombuffer(flat, dtype=np.int64, count=2 * n, offset=8).tolist()
    words, out = iter(flat[8 * (2 * n + 1) :].split(b" ")), {}
    for count, k in zip(sizes[::2], sizes[1::2], strict=True):
        out[tuple(next(words) for _ in range(k))] = count
    return out


def nodes(lang: str, number: int, run: Run, seeds: dict[tuple[bytes, ...], int], bounds: Bounds, support: int) -> Iterator[tuple]:
    """Rows of NODES: the phrases of a merged range that are frequent and start in it, and (m = 0) the windows of the range."""
    yield lang, 0, "", int(run.counts.sum()), []
    # what other ranges hold of the nodes on a range's edges: rows of no count lend them a place in the walk
    known, extra = dict(zip(run.words, range(1, len(run.words) + 1), strict=True)), {}
    if seeds:
        words = sorted({*run.words, *(w for p in seeds for w in p)})
        known = {w: i for i, w in enumerate(words, 1)}
        number_of = np.array([0, *map(known.__getitem__, run.words)], dtype=np.int32)
        edge = np.zeros((DEPTH, len(seeds)), dtype=np.int32)
        for i, p in enumerate(seeds):
            edge[: len(p), i] = [known[w] for w in p]
        run = Run(words, *_counted(np.concatenate([number_of[run.rows], edge], axis=1), np.concatenate([run.counts, np.zeros(len(seeds), dtype=np.int64)]), len(words)))
        extra = {tuple(known[w] for w in p): n for p, n in seeds.items()}
    rows, size = run.rows, len(run.counts)
    if not size:
        return
    new, starts, f = np.zeros(size, dtype=bool), [], []
    new[0] = True
    for k in range(DEPTH):
        new[1:] |= rows[k, 1:] != rows[k, :-1]
        at = np.flatnonzero(new)
        starts.append(at)
        f.append(np.add.reduceat(run.counts, at))
    for p, n in extra.items():  # the first row of its stretch is the edge's own
        lo, hi = 0, size
        for k, w in enumerate(p):
            lo, hi = lo + int(np.searchsorted(rows[k, lo:hi], w, "left")), lo + int(np.searchsorted(rows[k, lo:hi], w, "right"))
        f[len(p) - 1][np.searchsorted(starts[len(p) - 1], lo)] += n
    own = lang.encode()
    edges = {w[:k] for at in (number - 1, number) if 0 <= at < len(bounds) and bounds[at][0] == own for w in [bounds[at][1]] for k in range(1, DEPTH)}
    for k in range(DEPTH):
        for i in np.flatnonzero((f[k] >= support) & (rows[k, starts[k]] > 0)).tolist():
            at = starts[k][i]
            phrase = tuple(run.words[x - 1] for x in rows[: k + 1, at].tolist())
            if phrase in edges and bisect.bisect_right(bounds, (own, phrase)) != number:
                continue  # it starts in another range, which reports it
            lefts = [int(f[j][np.searchsorted(starts[j], at, "right") - 1]) for j in range(k)]
            yield lang, k + 1, b" ".join(phrase).decode(), int(f[k][i]), lefts


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            size, got = 0, []
            for words, _ in tokens(text):
                size += len(words)
                for i in range(0, len(words), max(1, len(words) // SAMPLE_WINDOWS)):
                    window = words[i : i + DEPTH]
                    window = window[: window.index(_MARK)] if _MARK in window else window
                    got += [b" ".join(window)] if window and len(got) < 2 * SAMPLE_WINDOWS else []
            rows = [pa.array([lang]), pa.array([size], pa.int64()), pa.array([got], pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(rows, ["lang", "size", "windows"])


def boundaries(texts: DataFrame) -> Bounds:
    """Starts of all prefix ranges but the first, in order: (lang, window), quantiles of a bounded sample.

    They share the work out and change no result.
    """
    spark, count = texts.sparkSession, texts.count()
    if not count:
        return []
    some = texts.sample(min(1.0, SAMPLE_TEXTS / count), 7) if count > SAMPLE_TEXTS else texts
    rows = some.mapInArrow(_sample, "lang string, size long, windows array<binary>").limit(2 * SAMPLE_TEXTS).collect()
    found = sorted({(r.lang.encode(), tuple(w.split(b" "))) for r in rows for w in map(bytes, r.windows)})
    words = sum(r.size for r in rows) * count / max(1, len(rows))
    n = min(MAX_RANGES, partitions_for(spark, int(words), RANGE_WINDOWS), len(found))
    return sorted({found[len(found) * i // n] for i in range(1, n)}) if n else []


def runs(texts: DataFrame, bounds: Bounds) -> DataFrame:
    """Rows of RUN: every shard's trie, cut at the boundaries."""
    sent = texts.sparkSession.sparkContext.broadcast(bounds)
    schema = pa.schema([("range", pa.int32()), ("lang", pa.string()), ("words", pa.binary()), ("windows", pa.binary()), ("seeds", pa.binary())])

    def batch(lang: str, shard: Shard) -> Iterator[pa.RecordBatch]:
        for row in cut_run(lang, shard.run(), sent.value):
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, Shard] = {}
        size = 0
        for b in batches:
            langs = b.column(0).to_pylist()
            for s, texts_ in slices(b.column(1)):
                for i, text in enumerate(texts_):
                    shard = shards.setdefault(langs[s + i], Shard())
                    shard.add(text)
                    size += len(text)
                    if shard.full() or len(shards) > OPEN_SHARDS or size >= 2 * SHARD_BYTES:
                        full = max(shards, key=lambda k: shards[k].bytes)
                        size -= shards[full].bytes
                        yield from batch(full, shards.pop(full))
        for lang in list(shards):
            yield from batch(lang, shards.pop(lang))
        release()

    return texts.mapInArrow(run, RUN)


def phrases(texts: DataFrame, support: int = SUPPORT) -> DataFrame:
    """Rows of NODES: every phrase of up to DEPTH words with f >= support, and parts of each language's count of words (m = 0)."""
    bounds = boundaries(texts)
    sent = texts.sparkSession.sparkContext.broadcast(bounds)
    schema = pa.schema([("lang", pa.string()), ("m", pa.int32()), ("phrase", pa.string()), ("f", pa.int64()), ("lefts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack, seeds, fresh = None, [], {}, 0

        def done() -> Iterator[pa.RecordBatch]:
            merged, rows = Run.merged(stack), []
            for row in nodes(at[1], at[0], merged, seeds, sent.value, support):
                rows.append(row)
                if len(rows) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for b in batches:
            for number, lang, words, windows, more in zip(*(b.column(i) for i in range(5)), strict=True):
                key = (number.as_py(), lang.as_py())
                if key != at:
                    if at is not None:
                        yield from done()
                    at, stack, seeds, fresh = key, [], {}, 0
                stack.append(Run.unpacked(words.as_py(), windows.as_py()))
                fresh += len(stack[-1].counts)
                if fresh > MERGE_WINDOWS and 2 * fresh > len(stack[0].counts):  # the first is what was merged before
                    stack, fresh = [Run.merged(stack)], 0
                    release()
                for p, n in _seeds(more.as_py()).items():
                    seeds[p] = seeds.get(p, 0) + n
        if at is not None:
            yield from done()
        release()

    dealt = runs(texts, bounds).repartitionById(len(bounds) + 1, "range").sortWithinPartitions("range", "lang")
    return dealt.mapInArrow(run, NODES)


def with_rights(found: DataFrame) -> DataFrame:
    """found (m > 0) with `rights`, the counts of the phrase without its first word, its first two words and so on, along suffix links."""
    of = lambda m: found.where(F.col("m") == m)
    levels = [of(1).withColumn("rights", F.array().cast("array<bigint>"))]
    for m in range(2, DEPTH + 1):
        link = levels[-1].select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"), F.concat(F.array("f"), "rights").alias("rights"))
        suffix = F.substring("phrase", F.locate(" ", "phrase") + 1, F.length("phrase"))
        levels.append(of(m).withColumn("_s", suffix).join(link, (F.col("lang") == F.col("_l")) & (F.col("_s") == F.col("_p"))).drop("_l", "_p", "_s"))
    out = levels[1]
    for level in levels[2:]:
        out = out.unionByName(level)
    return out


def _best_cut(a: Column, m: Column) -> Column:
    """(score, k, l, r) of the cut with the lowest score; products are decimals of 38 digits."""
    scaled = a.cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(7,0)")
    scores = F.transform(F.sequence(F.lit(1), m - 1), lambda k: F.struct(k.alias("k"), F.get("lefts", k - 1).alias("l"), F.get("rights", k - 1).alias("r")))
    whole = F.transform(scores, lambda c: F.struct(F.call_function("div", scaled, c["l"].cast("decimal(19,0)") + c["r"].cast("decimal(19,0)")).cast("bigint").alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r")))
    return F.array_min(whole)


def collocations(docs: DataFrame, support: int = SUPPORT, subsumed: int = SUBSUMED, best: int = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `best` phrases of 2 to DEPTH words."""
    work: list[str] = []
    found = written(phrases(_texts(docs), support), "phrases", work)
    n = found.where("m = 0").groupBy(F.col("lang").alias("_lang")).agg(F.sum("f").alias("n"))
    every = written(with_rights(found.where("m > 0")), "candidates", work)
    words = F.split("phrase", " ")
    part = lambda i, k: F.array_join(F.slice(words, i + 1, k), " ")
    inner = F.array(*[F.when(F.col("m") >= i + k, part(i, k)) for k in (2, 3) for i in range(DEPTH - k + 1)])
    longer = every.where("m > 2").select("lang", "f", "m", F.explode(inner).alias("phrase")).where("phrase is not null")
    # all that lies in a phrase of three words are its two pairs, not itself
    longer = longer.where(F.size(F.split("phrase", " ")) < F.col("m")).groupBy(F.col("lang").alias("_l"), F.col("phrase").alias("_p")).agg(F.max("f").alias("_longer"))
    big = lambda c, by: F.col(c).cast("decimal(20,0)") * by
    kept = every.join(longer, (F.col("lang") == F.col("_l")) & (F.col("phrase") == F.col("_p")), "left").where(F.col("_longer").isNull() | (big("_longer", 100) < big("f", subsumed)))
    kept = kept.withColumn("_cut", _best_cut(F.col("f"), F.col("m"))).select("lang", "phrase", F.col("f").alias("a"), "_cut.l", "_cut.r", "_cut.score")
    kept = written(kept, "collocations", work)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    top = in_order(kept, ["lang"], order, "rank", "ranked", first=best)
    out = written(top.join(n, F.col("lang") == F.col("_lang")).select("lang", (F.col("rank") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score"), "top-collocations")
    discard(docs.sparkSession, work)
    return out


#: DuckDB SQL with the rows of `collocations`.
ORACLE = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
f AS (SELECT lang, m, ws[i:i + m - 1] AS ph, count(*) AS f FROM i, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(ws) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT lang, m, f, ph FROM f WHERE f >= 30),
k AS MATERIALIZED (SELECT c.*, k, ph[1:k] AS lp, ph[k + 1:m] AS rp FROM c, (SELECT unnest([1, 2, 3]) AS k) WHERE k < m),
cut AS (SELECT k.lang, k.m, k.ph, k.f AS a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * k.f) // (l.f + r.f) AS score FROM k JOIN c l ON l.lang = k.lang AND l.ph = k.lp JOIN c r ON r.lang = k.lang AND r.ph = k.rp),
b AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
s AS (SELECT lang, ph[j:j + q - 1] AS ph, max(f) AS longer FROM c, (SELECT unnest([2, 3]) AS q), (SELECT unnest([1, 2, 3]) AS j) WHERE q < m AND j + q - 1 <= m GROUP BY ALL),
t AS (SELECT b.lang, array_to_string(ph, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN s USING (lang, ph) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, row_number() OVER o AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM t JOIN n USING (lang) WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER o <= 2000
"""
