"""Operator 5: benchmark decontamination with item-sized SimHash windows.

For each benchmark item every window of the item's own length in words slides over a
document. Windows that share no 5-word shingle with an item of that length have similarity
zero and are passed over; the others get a 64-bit SimHash from prefix sums of shingle bits.
Items are indexed by eight 8-bit blocks: of up to 23 differing bits some block has at most
two. For each block and value a posting list, kept as a bitmap (256 bytes an item for all
lists), holds the items whose block is in the value's ball of two bits; the union of a
window's eight lists has every item within the radius. Items that share no shingle with the document
are struck off, and what is left within the radius is verified by the exact weighted
similarity of the shingle multisets, sum(min) / sum(max), which must reach 0.8. (At that
similarity the expected distance is under 10 bits with a deviation of 3, so a radius of 23
is 4.5 deviations off; the README has measured recall.)

Words are runs of ASCII letters and digits and non-ASCII characters, lower-cased. Items
of fewer than five words are one shingle; a document shorter than an item is one window.

The benchmark is a stated query set. It is sent to the executors in blocks of at most
`max_chars` characters (an item that is longer is a block), each block being one pass over the documents. The driver
holds one block at a time: where there are several, each pass is written before the next block is read. A process
builds a block's index once.

Nulls and rows: null or empty texts and items without words match nothing; rows with a null
id still give rows; repeated documents or items each give their rows; ties between windows
go to the first; empty tables give an empty result; further columns are ignored by
`contaminated` and kept by `clean`. Long texts are hashed block by block and windows taken
in chunks, so memory grows with a text's words (8 bytes each) and not with windows times items.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NON_WORD, WordHasher, discard, mix, slices, written

WORDS = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCKS = 8
MAX_CHARS = 8_000_000
#: Bytes of the bitmaps of windows by items looked at at once.
_CELLS = 1 << 23
SCHEMA = "doc_id long, item_id long, similarity double, start_word long, n_words long, distance int, n_windows long"
_hasher = WordHasher(NON_WORD)
_FACTORS = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) | 1) for i in range(WORDS)]


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of word hashes h."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out += h[j : j + n] * _FACTORS[j]
    return mix(out)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """sum(min) / sum(max) of two shingle multisets."""
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    both = int(np.minimum(ca[i], cb[j]).sum())
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    return [h for _, h in _hasher.texts([(t or "").lower().encode() for t in texts])]


def _bits(sh: np.ndarray) -> np.ndarray:
    return np.unpackbits(sh.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


class Group:
    """The items of one length: shingles, which items hold each, fingerprints and the block index."""

    def __init__(self, length: int, items: list[tuple[int, np.ndarray]]):
        self.length, self.k = length, min(WORDS, length)
        self.ids = [i for i, _ in items]
        self.sh = [np.sort(shingles(h, self.k)) for _, h in items]
        value = np.concatenate(self.sh)
        holder = np.repeat(np.arange(len(items), dtype=np.int32), [len(x) for x in self.sh])
        order = np.argsort(value, kind="stable")
        self.value, self.holder = value[order], holder[order]
        self.fp = np.concatenate([np.packbits(_bits(x).sum(axis=0, dtype=np.int64) * 2 > len(x)) for x in self.sh]).reshape(-1, BLOCKS)
        reach = RADIUS // BLOCKS
        values = np.arange(256, dtype=np.uint8)
        self.posting = [np.packbits(np.bitwise_count(values[:, None] ^ self.fp[None, :, b]) <= reach, axis=1) for b in range(BLOCKS)]

    def holding(self, values: np.ndarray) -> np.ndarray:
        """A bitmap of the items that hold any of the different shingles `values`."""
        lo, hi = np.searchsorted(self.value, values, "left"), np.searchsorted(self.value, values, "right")
        count = hi - lo
        some = np.zeros(len(self.ids), dtype=bool)
        some[self.holder[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())]] = True
        return np.packbits(some)

    def able(self, region: np.ndarray, size: int) -> np.ndarray:
        """Of which items a region holds so many shingles that a window of `size` could be similar."""
        values, times = np.unique(region, return_counts=True)
        lo, hi = np.searchsorted(self.value, values, "left"), np.searchsorted(self.value, values, "right")
        count = hi - lo
        at = self.holder[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())]
        shared = np.bincount(at, weights=np.repeat(times, count), minlength=len(self.ids))
        return shared * (1 + SIMILARITY) >= SIMILARITY * (size + self.length - self.k + 1) - 1e-6

    def candidates(self, fp: np.ndarray, among: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, item, distance) of all pairs within the radius, of items in the bitmap `among`, found through the blocks."""
        step = max(1, _CELLS // len(among))
        for at in range(0, len(fp), step):
            part = fp[at : at + step]
            hit = self.posting[0][part[:, 0]]
            for b in range(1, BLOCKS):
                hit |= self.posting[b][part[:, b]]
            hit &= among
            w, byte = np.nonzero(hit)
            for s in range(0, len(w), _CELLS // 16):
                some, bit = np.nonzero(np.unpackbits(hit[w[s : s + _CELLS // 16], byte[s : s + _CELLS // 16]][:, None], axis=1))
                wi, i = w[s + some], byte[s + some] * 8 + bit
                d = np.bitwise_count(part[wi] ^ self.fp[i]).sum(axis=1, dtype=np.int64)
                ok = d <= RADIUS
                yield at + wi[ok], i[ok], d[ok]


class Index:
    def __init__(self, items: list[tuple[int, str | None]]):
        by = defaultdict(list)
        for (i, _), h in zip(items, word_hashes([t for _, t in items]), strict=True):
            if len(h):
                by[len(h)].append((i, h))
        self.groups = [Group(n, got) for n, got in sorted(by.items())]
        self.known = {}
        for k in {g.k for g in self.groups}:
            got = [(np.unique(group.value), g) for g, group in enumerate(self.groups) if group.k == k]
            value = np.concatenate([s for s, _ in got])
            owner = np.concatenate([np.full(len(s), g) for s, g in got])
            order = np.lexsort((owner, value))
            value, owner = value[order], owner[order]
            mask = np.zeros(1 << 20, dtype=bool)
            mask[(value >> np.uint64(44)).astype(np.int64)] = True
            self.known[k] = (value, owner, mask)

    def matches(self, h: np.ndarray) -> Iterator[tuple]:
        """(item id, similarity, start, words, distance, windows) of one text's word hashes."""
        for k, (value, owner, mask) in self.known.items():
            sh = shingles(h, k)
            at = np.flatnonzero(mask[(sh >> np.uint64(44)).astype(np.int64)])
            if not len(at):
                continue
            found, which = np.unique(sh[at], return_inverse=True)
            lo, hi = np.searchsorted(value, found, "left"), np.searchsorted(value, found, "right")
            count = hi - lo
            of = np.repeat(np.arange(len(found)), count)
            owners = owner[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())]
            for g in np.unique(owners):
                mine = np.zeros(len(found), dtype=bool)
                mine[of[owners == g]] = True
                yield from self._group(self.groups[g], sh, at[mine[which]], self.groups[g].holding(found[mine]))

    def _group(self, group: Group, sh: np.ndarray, places: np.ndarray, among: np.ndarray) -> Iterator[tuple]:
        size = min(group.length - group.k + 1, len(sh))
        last = len(sh) - size
        opened = np.zeros(len(sh) + 1, dtype=np.int32)
        np.add.at(opened, np.clip(places - size + 1, 0, last), 1)
        np.add.at(opened, np.minimum(places, last) + 1, -1)
        starts = np.flatnonzero(np.cumsum(opened[:-1]) > 0)
        best: dict[int, list] = {}
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
            for c in range(0, len(part), 8192):
                self._windows(group, sh, part[c : c + 8192], size, among, best)
        for i, (sim, start, d, n) in sorted(best.items()):
            yield group.ids[i], sim, start, min(group.length, size + group.k - 1), d, n

    @staticmethod
    def _windows(group: Group, sh: np.ndarray, starts: np.ndarray, size: int, among: np.ndarray, best: dict[int, list]) -> None:
        region = sh[starts[0] : starts[-1] + size]
        rel = starts - starts[0]
        fp = np.concatenate([_fingerprints(region, rel[at : at + 2048], size) for at in range(0, len(rel), 2048)])
        able = group.able(region, size)
        for window, item, distance in group.candidates(fp, among):
            window, item, distance = (x[able[item]] for x in (window, item, distance))
            order = np.argsort(item, kind="stable")
            for mine in np.split(order, np.flatnonzero(np.diff(item[order])) + 1) if len(order) else []:
                i = int(item[mine[0]])
                known = np.concatenate([[0], np.cumsum(np.isin(region, group.sh[i]))])
                w = window[mine]
                most = known[rel[w] + size] - known[rel[w]]
                able = most >= SIMILARITY * (size + len(group.sh[i]) - most)
                for s, d in zip(rel[w[able]].tolist(), distance[mine][able].tolist(), strict=True):
                    sim = similarity(region[s : s + size], group.sh[i])
                    if sim >= SIMILARITY:
                        b = best.setdefault(i, [0.0, 0, 0, 0])
                        b[3] += 1
                        if sim > b[0]:
                            b[:3] = sim, int(starts[0]) + s, d


def _fingerprints(region: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The SimHash of the window of `size` shingles at each of the ascending starts."""
    part = region[starts[0] : starts[-1] + size]
    total = np.zeros((len(part) + 1, 64), dtype=np.int32)
    for at in range(0, len(part), 1 << 14):
        got = np.cumsum(_bits(part[at : at + (1 << 14)]), axis=0, dtype=np.int32)
        total[at + 1 : at + 1 + len(got)] = got + total[at]
    rel = starts - starts[0]
    return np.packbits((total[rel + size] - total[rel]) * 2 > size, axis=1)


_built: dict[str, Index] = {}


def _index(block: tuple[str, list]) -> Index:
    """The process's index of a block; an earlier block's makes room for it."""
    if block[0] not in _built:
        _built.clear()
        _built[block[0]] = Index(block[1])
    return _built[block[0]]


def _sent(docs: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, max_chars: int) -> Iterator[tuple[int, Broadcast]]:
    """(number of blocks, broadcast) of the benchmark's blocks of items, one after another; each is given up for the next."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null")
    n_blocks = max(1, -(-(items.agg(F.sum(F.length("t"))).first()[0] or 0) // max_chars))
    for b in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == b).collect()
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, sorted(((r.i, r.t) for r in part), key=lambda r: (r[0] is None, r[0] or 0, r[1]))))
        yield n_blocks, sent
        if n_blocks > 1:
            sent.destroy()


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", max_chars: int = MAX_CHARS) -> DataFrame:
    """One row for each document and benchmark item that it holds: best window and how many windows match."""
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    parts = []
    for n, sent in _sent(docs, benchmark, item_id, item_text, max_chars):
        found = src.mapInArrow(_scan(sent), SCHEMA)
        parts.append(written(found, "contaminated") if n > 1 else found)
    return reduce(DataFrame.union, parts)


def _scan(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(sent.value)
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            for s, texts in slices(b.column(1)):
                for i, h in enumerate(word_hashes(texts), s):
                    rows += [(ids[i], *m) for m in index.matches(h)]
            if rows:
                names = ["doc_id", "item_id", "similarity", "start_word", "n_words", "distance", "n_windows"]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", max_chars: int = MAX_CHARS) -> DataFrame:
    """docs without those that hold a benchmark item: each row is judged where it stands, whatever its id."""
    out = docs
    work: list[str] = []
    for n, sent in _sent(docs, benchmark, item_id, item_text, max_chars):
        src = out.select(F.struct(*docs.columns).alias("row"), F.col(text).cast("string").alias("text"))
        out = src.mapInArrow(_keep(sent), src.select("row").schema).select("row.*")
        if n > 1:
            before, work = work, []
            out = written(out, "uncontaminated", work)
            discard(docs.sparkSession, before)
    return out


def _keep(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(sent.value)
        for b in batches:
            good = [next(index.matches(h), None) is None for _, texts in slices(b.column(1)) for h in word_hashes(texts)]
            kept = b.select([0]).filter(pa.array(good, pa.bool_()))
            if kept.num_rows:
                yield kept

    return run
