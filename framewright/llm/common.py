"""Shared pieces of the training-data operators: work tables, word hashing, components."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Separator bytes of `[^\x20\x09-\x0D]+` words.
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
#: Bytes that are no part of a letter, digit or non-ASCII character.
NON_WORD = bytes(b for b in range(128) if not chr(b).isalnum())
PUNCTUATION = bytes(b for b in NON_WORD if b not in SPACES)
BLOCK = 1 << 20
#: Rows of a range of `in_order`, and the most ranges.
RANGE_ROWS, MAX_RANGES = 1 << 20, 50_000
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared work folder (spark.checkpoint.dir); one of our own only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jsc_dir.isDefined():
            return jsc_dir.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="framewright-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def written(df: DataFrame, name: str, work: list[str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here and a lost executor loses nothing.

    The table's path is added to `work`, for `discard` once nothing reads it any more.
    """
    path = f"{shared_dir(df.sparkSession)}/framewright-{name}-{uuid.uuid4().hex}"
    if work is not None:
        work.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, work: list[str]) -> None:
    """Deletes work tables."""
    for path in work:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    work.clear()


class Numbered:
    """A written copy of a table whose rows carry a number, so that results found for rows join to it by number
    while its rows, long texts included, stay where they are.

    `row` is monotonically_increasing_id() at the time of writing; its upper bits, `part`, tell the task that
    wrote the row. The copy is bucketed by `part`: each task writes one file, and results, dealt out by `part`
    into as many buckets, meet it row by row in a hash join of which only the other side is shuffled, at every size.
    A task's hash table holds one entry for each result of its bucket; time is linear in rows and results. For this
    join on (part, row) to keep the texts' places, the session's requireAllClusterKeysForCoPartition is set to false:
    Spark may then use a partitioning by some of a join's keys.
    """

    MAX_BUCKETS = 100_000

    def __init__(self, docs: DataFrame, name: str):
        spark = docs.sparkSession
        self.columns, self.row, self.part = docs.columns, free_name(docs, "_row"), free_name(docs, "_part")
        self.buckets = min(self.MAX_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        unique = uuid.uuid4().hex
        copy = docs.withColumn(self.row, F.monotonically_increasing_id()).withColumn(self.part, F.shiftright(self.row, 33))
        at = copy.write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/framewright-{name}-{unique}").bucketBy(self.buckets, self.part)
        try:
            at.saveAsTable(f"framewright_{unique}")
            self.df = spark.table(f"framewright_{unique}")
        finally:
            spark.sql(f"DROP TABLE IF EXISTS framewright_{unique}")  # the catalogue's entry only: the files are read on

    def joined(self, found: DataFrame, value: str) -> DataFrame:
        """The copy with column `value` of `found` (`row`, `value`; a row at most once), null where found has no such row."""
        row, part = self.row, self.part
        mine, of = free_name(self.df, "_found_row"), free_name(self.df, "_found_part")
        some = found.select(F.col(row).alias(mine), F.col(value).alias(value)).withColumn(of, F.shiftright(mine, 33)).repartition(self.buckets, of)
        at = self.df.join(some.hint("shuffle_hash"), (F.col(part) == F.col(of)) & (F.col(row) == F.col(mine)), "left")
        return at.select(*self.columns, row, value)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions_for(spark: SparkSession, rows: int, rows_each: int) -> int:
    """So many partitions that none has many more rows than rows_each, and at least the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def in_order(rows: DataFrame, group: list[str], order: list[Column], out: str, name: str, first: int | None = None) -> DataFrame:
    """rows with each one's number, from 0, in its group by `order`; with `first`, only each group's first so many rows.

    Ranges of (group, order) are written sorted, so a large group lies in many tasks; a group's number in a range is
    what stands in the ranges before plus the place in its own. A range and group give one row of counts.
    """
    spark = rows.sparkSession
    part, at = free_name(rows, "_range"), free_name(rows, "_at")
    n = min(MAX_RANGES, partitions_for(spark, rows.count(), RANGE_ROWS))
    keys = [*map(F.col, group), *order]
    laid = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().alias(at))
    laid = written(laid, name)
    counts = laid.groupBy(*group, part).agg(F.count("*").alias("_n"), F.min(at).alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy(part)) - F.col("_n")
    places = counts.withColumn("_before", before).where(F.lit(first is None) | (F.col("_before") < F.lit(first or 0)))
    places = places.select(F.struct(*group).alias("_of"), F.col(part).alias("_part"), (F.col("_before") - F.col("_first")).alias("_shift"))
    # at most MAX_RANGES rows more than there are groups
    got = laid.join(places, F.struct(*group).eqNullSafe(F.col("_of")) & (F.col(part) == F.col("_part"))).withColumn(out, F.col(at) + F.col("_shift"))
    got = got if first is None else got.where(F.col(out) < first)
    return got.select(*rows.columns, out)


def slices(texts: pa.Array, limit: int = 2 * BLOCK) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of ranges of about `limit` bytes each (one text may be longer)."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)] if len(texts) else [0]
    for s, e in zip(cuts, cuts[1:], strict=False):
        yield s, texts.slice(s, e - s).to_pylist()
    release()


def release() -> None:
    """Gives freed memory back to the system: a worker process outlives its task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class WordHasher:
    """64-bit hashes of all words of many texts by array operations alone.

    A prefix sum of byte * P**position (mod 2**64) gives each word's polynomial as a
    difference, made independent of its place by the inverse power. Blocks of about
    a megabyte bound the memory whatever the length of a text or a word.
    """

    def __init__(self, separators: bytes, apart: bytes = b""):
        """Words are runs of bytes other than separators; runs of the bytes `apart` are words of their own."""
        self.kind = np.ones(256, dtype=np.uint8)
        self.kind[list(apart)] = 2
        self.kind[list(separators)] = 0
        self.separator = self.kind == 0
        self.value = np.arange(1, 257, dtype=np.uint64)

    #: Shared by all hashers of a process.
    power = inverse = np.ones(1, dtype=np.uint64)

    @staticmethod
    def _powers(n: int) -> None:
        if len(WordHasher.power) < n:
            n = max(n, BLOCK + 4096)
            one = np.ones(1, dtype=np.uint64)
            WordHasher.power = np.concatenate([one, np.full(n - 1, _P, dtype=np.uint64)]).cumprod(dtype=np.uint64)
            WordHasher.inverse = np.concatenate([one, np.full(n - 1, _P_INV, dtype=np.uint64)]).cumprod(dtype=np.uint64)

    def block(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, starts and ends (in bytes) of the words of one block."""
        sums, start, end = self._sums(data)
        return mix(sums), start, end

    def _sums(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = np.frombuffer(data, dtype=np.uint8)
        kind = np.zeros(len(raw) + 2, dtype=np.uint8)
        kind[1:-1] = self.kind[raw]
        edge = kind[1:] != kind[:-1]
        start, end = np.flatnonzero(edge & (kind[1:] != 0)), np.flatnonzero(edge & (kind[:-1] != 0))
        self._powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(self.value[raw] * self.power[: len(raw)], out=total[1:])
        return (total[end] - total[start]) * self.inverse[start], start, end

    def long(self, data: bytes) -> Iterator[np.ndarray]:
        """Word hashes of a long text, a block at a time; a word may reach over any number of blocks."""
        held, size, of = None, 0, 0
        for at in range(0, len(data), BLOCK):
            part = data[at : at + BLOCK]
            sums, start, end = self._sums(part)
            if held is not None:
                if len(start) and not start[0] and self.kind[part[0]] == of:
                    sums[:1] = sums[:1] * np.uint64(pow(_P, size, 1 << 64)) + held  # arrays wrap around without a word
                    end[0] += size
                else:
                    yield mix(np.array([held], dtype=np.uint64))
                held = None
            if len(end) and self.kind[part[-1]]:
                held, of = sums[-1], self.kind[part[-1]]
                size, sums = int(end[-1] - start[-1]), sums[:-1]
            yield mix(sums)
        if held is not None:
            yield mix(np.array([held], dtype=np.uint64))

    def cut(self, data: bytes) -> Iterator[bytes]:
        """Blocks of a long text, ending at separators."""
        at = 0
        while at < len(data):
            end = min(at + BLOCK, len(data))
            if end < len(data):
                raw = np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at)
                last = np.flatnonzero(self.separator[raw])
                if len(last):
                    end = at + int(last[-1]) + 1
                else:
                    while end < len(data) and not self.separator[data[end]]:
                        end += 1
            yield data[at:end]
            at = end

    def texts(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """(index, word hashes) of each text, in order."""
        start, size = 0, 0
        for i in range(len(texts) + 1):
            full = i == len(texts) or size + len(texts[i]) > BLOCK
            if full and i > start:
                yield from self._small(texts, start, i)
                start, size = i, 0
            if i < len(texts):
                if len(texts[i]) > BLOCK:
                    yield i, np.concatenate(list(self.long(texts[i])))
                    start, size = i + 1, 0
                else:
                    size += len(texts[i])

    def _small(self, texts: list[bytes], start: int, end: int) -> Iterator[tuple[int, np.ndarray]]:
        part = texts[start:end]
        h, at, _ = self.block(b"\n".join(part))
        offset = np.cumsum([0, *(len(t) + 1 for t in part)])
        cut = np.searchsorted(at, offset)
        for k in range(len(part)):
            yield start + k, h[cut[k] : cut[k + 1]]


def components(edges: DataFrame, name: str, work: list[str] | None = None, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long); root is the component's smallest node.

    Alternating large-star and small-star rounds; each round's edges are a written
    table. Rounds end when the edges no longer change. A hub's rows meet only in
    sort-merge joins of written tables (which adaptive execution splits) and in min()
    with map-side combining, so no task or driver gathers a component.
    """
    done: list[str] = []
    at = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name, done)
    before = None
    for _ in range(max_rounds):
        both = at.union(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        now: list[str] = []
        least = written(both.groupBy("a").agg(F.min("b").alias("m")), name, done)
        large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        large = written(large, name, done)
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), name, done)
        small = large.join(least.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        at = written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), name, now)
        discard(at.sparkSession, done)
        done = now
        state = at.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if work is not None:
        work += done
    return at.select(F.col("a").alias("node"), F.col("b").alias("root")).union(at.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
