"""Operator 10: token ids in Simple-8b word-aligned coding.

A segment holds the ids of consecutive documents. Each 64-bit word has a 4-bit selector
and as many ids as the selector's width allows in the other 60 bits. An id that is wider
than its neighbours may be written as an escape (all ones) with its value in a list of
exceptions. Ids are coded in blocks of 32,768, each with the offsets of its first word and
first exception, so that one block can be decoded alone; all words of one selector are
decoded at once by array operations.

Segment layout, little-endian: magic "FW8B", then unsigned 32-bit counts of documents, ids,
blocks, words and exceptions; document ids (int64), whether each is null (uint8), lengths
(uint32); first word and first exception of each block (uint32); words (uint64); exceptions
(uint32).

Files: documents are range-partitioned and sorted by (doc_id, hash of the text), so a
repeated id cannot fill one task. Each partition writes its segments of about
`segment_ids` ids in order, by Spark's committed writer, as the binary column of a Parquet
table (part, seq, start within the part, ids, payload). Reading decodes each segment and
adds the ids of earlier parts, of which there are as many as partitions.

Nulls and rows: a null text counts as empty and gives its end id; null ids come first;
repeated rows are each written, rows of equal id in the order of their texts' hashes; a text of any length lies
within one segment; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, shared_dir, slices
from .tokens import encoder

MAGIC = b"FW8B"
END = 2
BLOCK_IDS = 1 << 15
SEGMENT_IDS = 1 << 18
#: A file set has at most so many parts; of larger tables each part takes more documents, a batch at a time.
MAX_PARTS = 50_000
#: Fixed selector table of Simple-8b: ids in a word; 60 // ids bits each. Selectors 0 and 1 are runs of zeros.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)
#: Selectors whose all-ones value is an escape: narrower ids would gain nothing.
ESCAPES = (12, 13)
#: Bits of each 16-bit number.
_LENGTH = np.ceil(np.log2(np.arange(1, (1 << 16) + 1))).astype(np.uint8)


def encode_block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, exceptions) of one block."""
    n = len(ids)
    bits = _LENGTH[ids & np.uint32(0xFFFF)] if not n or ids.max() <= 0xFFFF else np.where(ids > 0xFFFF, 16 + _LENGTH[ids >> np.uint32(16)], _LENGTH[ids & np.uint32(0xFFFF)])
    widest = int(np.searchsorted(WIDTHS, int(ids.max()).bit_length())) if n else 0
    select = np.full(n, max(widest, 1), dtype=np.int64)
    for s in range(widest, -1, -1):
        count, width = int(COUNTS[s]), int(WIDTHS[s])
        ok = ids < (1 << width) - 1 if s in ESCAPES else bits <= width
        if s == 12:  # one wide id in a word may escape
            wide = np.concatenate([[0], np.cumsum(~ok), np.full(count, (~ok).sum())])
            select[wide[count : n + count] - wide[:n] <= 1] = s
            continue
        good = np.concatenate([np.flatnonzero(ok), np.arange(n, n + count - 1)])
        if len(good) >= count:
            runs = good[: len(good) - count + 1]
            select[runs[good[count - 1 :] - runs == count - 1]] = s
    v = ids.astype(np.uint64)
    step = COUNTS[select].tolist()
    at, i = [], 0
    while i < n:
        at.append(i)
        i += step[i]
    at = np.array(at, dtype=np.int64)
    chosen = select[at]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([v, np.zeros(240, dtype=np.uint64)])
    escaped = []
    for s in np.unique(chosen):
        width = int(WIDTHS[s])
        if not width:
            continue
        mine = np.flatnonzero(chosen == s)
        first, packed = at[mine], words[mine]
        top = np.uint64((1 << width) - 1)
        for j in range(int(COUNTS[s])):
            value = padded[first + j]
            if s in ESCAPES:
                over = value >= top
                escaped.append(first[over] + j)
                value = np.minimum(value, top)
            packed |= value << np.uint64(j * width)
        words[mine] = packed
    places = np.sort(np.concatenate(escaped)) if escaped else np.zeros(0, dtype=np.int64)
    return words, ids[places].astype(np.uint32)


def decode_words(words: np.ndarray, exceptions: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a block."""
    select = (words >> np.uint64(60)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(COUNTS[select])])
    out = np.zeros(int(first[-1]), dtype=np.uint32)
    escaped = []
    for s in np.unique(select):
        width = int(WIDTHS[s])
        if not width:
            continue
        mine = np.flatnonzero(select == s)
        mask = np.uint64((1 << width) - 1)
        value = (words[mine][:, None] >> (np.arange(COUNTS[s]) * width).astype(np.uint64)) & mask
        place = first[mine][:, None] + np.arange(COUNTS[s])
        out[place] = value.astype(np.uint32)
        if s in ESCAPES:
            escaped.append(place[value == mask])
    if escaped:
        out[np.sort(np.concatenate(escaped))] = exceptions
    return out[:n]


def encode_segment(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    every = np.frombuffer(b"".join(ids), dtype="<u4")
    blocks = [encode_block(every[i : i + BLOCK_IDS]) for i in range(0, len(every), BLOCK_IDS)]
    words, exceptions = (np.concatenate([b[k] for b in blocks]) if blocks else np.zeros(0, dtype=(np.uint64, np.uint32)[k]) for k in (0, 1))
    first = np.array([[0, 0], *([len(w), len(x)] for w, x in blocks[:-1])] if blocks else np.zeros((0, 2)), dtype=np.int64).cumsum(axis=0)
    head = struct.pack("<4s5I", MAGIC, len(ids), len(every), len(blocks), len(words), len(exceptions))
    parts = [np.array([i or 0 for i in doc_ids], dtype="<i8"), np.array([i is None for i in doc_ids], dtype="u1"), np.array([len(b) // 4 for b in ids], dtype="<u4"), first.T.astype("<u4"), words.astype("<u8"), exceptions.astype("<u4")]
    return head + b"".join(p.tobytes() for p in parts)


class Segment:
    """A segment read back; `block(i)` decodes one block alone."""

    def __init__(self, data: bytes):
        magic, docs, self.n_ids, blocks, words, exceptions = struct.unpack_from("<4s5I", data)
        if magic != MAGIC:
            raise ValueError("not a segment")
        at = 24

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += got.nbytes
            return got

        ids, null = take(docs, "<i8"), take(docs, "u1")
        self.doc_ids = [None if x else i for i, x in zip(ids.tolist(), null.tolist(), strict=True)]
        self.lengths = take(docs, "<u4").astype(np.int64)
        self.word_at, self.exception_at = (np.append(take(blocks, "<u4").astype(np.int64), n) for n in (words, exceptions))
        self.words, self.exceptions = take(words, "<u8"), take(exceptions, "<u4")

    def block(self, i: int) -> np.ndarray:
        n = min(BLOCK_IDS, self.n_ids - i * BLOCK_IDS)
        return decode_words(self.words[self.word_at[i] : self.word_at[i + 1]], self.exceptions[self.exception_at[i] : self.exception_at[i + 1]], n)

    def ids(self) -> np.ndarray:
        got = [self.block(i) for i in range(len(self.word_at) - 1)]
        return np.concatenate(got) if got else np.zeros(0, dtype=np.uint32)


def write(docs: DataFrame, out: str, path: str, end: int = END, text: str = "text", doc_id: str = "doc_id", segment_ids: int = SEGMENT_IDS) -> None:
    """Writes the ids of every document to `out`, in ascending doc_id order."""
    spark = docs.sparkSession
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, seq, start = encoder(path), TaskContext.get().partitionId(), 0, 0
        held_ids, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, start, held_ids, held, size
            row = [[part], [seq], [start], [size // 4], [encode_segment(held_ids, held)]]
            seq, start, held_ids, held, size = seq + 1, start + size // 4, [], [], 0
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds, strict=True)], ["part", "seq", "start", "n_ids", "payload"])

        for b in batches:
            ids = b.column(0).to_pylist()
            for s, texts in slices(b.column(1)):
                for i, got in zip(ids[s : s + len(texts)], enc.encode(texts), strict=True):
                    held_ids.append(i)
                    held.append(got + tail)
                    size += len(held[-1])
                    if size >= 4 * segment_ids:
                        yield flush()
        if held:
            yield flush()

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    n = min(MAX_PARTS, partitions_for(spark, src.count(), 20_000))
    dealt = src.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    dealt.mapInArrow(run, "part int, seq long, start long, n_ids long, payload binary").write.option("compression", "zstd").parquet(out)


def read(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files at `path`.

    The parts' places are broadcast: at most MAX_PARTS rows of two numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, start, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                seg = Segment(data)
                ids = seg.ids()
                ends = np.cumsum(seg.lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), seg.lengths.tolist(), strict=True)]
                cols = [pa.array(seg.doc_ids, pa.int64()), pa.array(np.full(len(crc), part, dtype=np.int32)), pa.array(start + ends - seg.lengths), pa.array(seg.lengths), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "part", "in_part", "n_tokens", "ids_crc32"])

    files = spark.read.schema("part int, seq long, start long, n_ids long, payload binary").parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    got = files.select("part", "start", "payload").mapInArrow(run, "doc_id long, part int, in_part long, n_tokens long, ids_crc32 long")
    return got.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """Writes docs to the shared folder and reads the files back."""
    import uuid

    out = f"{shared_dir(docs.sparkSession)}/framewright-ids-{uuid.uuid4().hex}"
    write(docs, out, path, end)
    return read(docs.sparkSession, out)
