"""Operator 9: packing documents into sequences by best fit and swap-based local search.

Each document becomes its ids and an end id; only documents longer than a sequence are cut,
into pieces of the sequence's length and a rest. Pieces are dealt round robin to bins of
work ("shards") of about `shard` pieces, independent of any key. Within a shard best-fit
decreasing gives a first packing. Local search then goes for the emptiest sequences: a
piece moves to a fuller sequence, or one piece, or two, are exchanged for a smaller one of
a fuller sequence, each step the largest that fits, so that the sum of squared fills always
grows; a sequence that runs empty is gone. It ends at the lower bound, ceil(tokens /
length), or when no exchange is left. A shard wastes less than one sequence beyond what
its pieces allow, so waste is at most about one sequence in `shard` pieces.

Only (id, piece, start, length, checksum) rows are dealt, never texts or ids.

Nulls and rows: a null text counts as empty and gives one piece, its end id; null ids and
repeated rows are packed like any other; ties go to the earlier piece; a text longer than a sequence is
cut into pieces, whatever its length; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .tokens import encoder

LENGTH = 4096
END = 1
SHARD = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, end: int = END, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each piece of each document's ids."""
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            ids = b.column(0).to_pylist()
            for s, texts in slices(b.column(1)):
                rows = []
                for i, got in zip(ids[s : s + len(texts)], enc.encode(texts), strict=True):
                    got += tail
                    for k in range(0, len(got), 4 * length):
                        part = got[k : k + 4 * length]
                        rows.append((i, k // (4 * length), k // 4, len(part) // 4, zlib.crc32(part)))
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PIECES)


def best_fit(sizes: list[int], cap: int) -> list[list[int]]:
    """Best-fit decreasing: indices of each bin."""
    bins: list[list[int]] = []
    slack: list[list[int]] = [[] for _ in range(cap + 1)]
    open_ = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n = sizes[i]
        fits = open_ >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = slack[room].pop()
            if not slack[room]:
                open_ &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = cap, len(bins)
            bins.append([i])
        if room > n:
            slack[room - n].append(b)
            open_ |= 1 << (room - n)
    return bins


class Search:
    """Local search over the bins that are not full."""

    def __init__(self, bins: list[list[int]], sizes: list[int], cap: int):
        self.sizes, self.cap, self.bins = sizes, cap, bins
        self.fill = [sum(sizes[i] for i in b) for b in bins]

    def run(self) -> list[list[int]]:
        least = -(-sum(self.fill) // self.cap)
        live = sum(f > 0 for f in self.fill)
        tried: set[int] = set()
        while live > least:
            some = [b for b in range(len(self.bins)) if 0 < self.fill[b] < self.cap and b not in tried]
            if not some:
                break
            a = min(some, key=lambda b: (self.fill[b], b))
            if self._empty(a):
                live -= 1
                tried.clear()
            else:
                tried.add(a)
        return [b for b in self.bins if b]

    def _empty(self, a: int) -> bool:
        """Moves and exchanges pieces of bin a with fuller bins while any step grows the squared fill."""
        under = np.array([b for b in range(len(self.bins)) if b != a and self.fill[a] <= self.fill[b] < self.cap], dtype=np.int64)
        if sum(self.cap - self.fill[b] for b in under) < self.fill[a]:
            return False
        item = np.array([i for b in under for i in self.bins[b]], dtype=np.int64)
        size = np.array([self.sizes[i] for i in item], dtype=np.int64)
        home = np.repeat(under, [len(self.bins[b]) for b in under])
        fill = np.array(self.fill, dtype=np.int64)
        while self.bins[a]:
            step = self._step(a, item, size, home, fill, under)
            if step is None:
                return False
            give, slot, b = step
            self.bins[a] = [i for i in self.bins[a] if i not in give]
            self.bins[b] += give
            if slot is None:
                item, size, home = (np.append(x, y) for x, y in ((item, give), (size, [self.sizes[i] for i in give]), (home, [b] * len(give))))
            else:
                back = int(item[slot])
                self.bins[b].remove(back)
                self.bins[a].append(back)
                item[slot], size[slot] = give[0], self.sizes[give[0]]
                if len(give) > 1:
                    item, size, home = np.append(item, give[1]), np.append(size, self.sizes[give[1]]), np.append(home, b)
            for x in (a, b):
                self.fill[x] = fill[x] = sum(self.sizes[i] for i in self.bins[x])
        return True

    def _step(self, a, item, size, home, fill, under):
        """The step (pieces given, slot taken back or None, bin) that moves most into a fuller bin."""
        slack = self.cap - fill
        room = slack[under]
        order = np.argsort(room, kind="stable")
        rooms = room[order].tolist()
        best, gain = None, 0
        mine = sorted(self.bins[a], key=lambda i: -self.sizes[i])
        for i in mine:
            at = bisect_left(rooms, self.sizes[i])
            if at < len(rooms) and self.sizes[i] > gain:
                best, gain = ([i], None, int(under[order[at]])), self.sizes[i]
                break
        limit = size + slack[home]
        # Pieces of one size are alike, and a bin holds few different sizes (their sum is at most its own).
        mine = [i for k, i in enumerate(mine) if k < 2 or self.sizes[mine[k - 2]] != self.sizes[i]]
        groups = [([i], self.sizes[i]) for i in mine]
        groups += [([i, j], self.sizes[i] + self.sizes[j]) for k, i in enumerate(mine) for j in mine[k + 1 :]]
        for give, n in groups:
            if n <= gain:
                continue
            got = np.where((limit >= n) & (size < n) & (fill[home] + n - size > fill[a]), n - size, 0)
            slot = int(got.argmax()) if len(got) else -1
            if slot >= 0 and got[slot] > gain:
                best, gain = (give, slot, int(home[slot])), int(got[slot])
        return best


def packed(docs: DataFrame, path: str, end: int = END, length: int = LENGTH, shard: int = SHARD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    got = written(pieces(docs, path, end, length, text, doc_id), "pieces")
    n = max(1, -(-got.count() // shard))
    return got.repartition(n).mapInArrow(_pack(length), PIECES + ", sequence_id long, offset long")


def _pack(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = [b for b in batches if b.num_rows]
        if not part:
            return
        rows = pa.Table.from_batches(part).combine_chunks().to_batches()[0]
        sizes = rows.column(3).to_pylist()
        bins = Search(best_fit(sizes, length), sizes, length).run()
        first = TaskContext.get().partitionId() << 32
        sequence, offset = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                sequence[i], offset[i] = first + k, at
                at += sizes[i]
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(sequence), pa.array(offset)], [*rows.schema.names, "sequence_id", "offset"])

    return run
