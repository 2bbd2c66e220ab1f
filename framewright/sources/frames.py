"""Coordinate frames: header-less float32 files and DCD trajectories, one row for each frame."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .files import CHUNK, all_seekable, listed, read_exactly, seekable, spread

F32_SCHEMA = "file string, frame int, xyz array<float>"
DCD_SCHEMA = "traj_id string, frame int, time_ps double, box_nm array<double>, xyz_nm array<float>"


#: Bytes of frames that one task reads.
TASK_BYTES = 64 << 20


def read_f32(spark: SparkSession, path: str, n_atoms: int, atoms: list[int] | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """file, frame, xyz of little-endian float32 files with n_atoms * 3 numbers a frame.

    A size that is no multiple of a frame raises. `atoms` gathers those atoms, in that order, at the
    source. Files of any size are read by ranges of frames, a task each; files in a store that only Spark
    can open are read whole (2 GiB at most each).
    """
    width = 3 * n_atoms
    columns = None if atoms is None else (np.asarray(atoms)[:, None] * 3 + np.arange(3)).ravel()
    at_once = max(1, min(256, CHUNK * 8 // (4 * width)))

    def checked(file: str, size: int) -> None:
        if size % (4 * width):
            raise ValueError(f"{file}: {size} bytes are no whole number of frames of {n_atoms} atoms")

    def rows(file: str, first: int, every: np.ndarray) -> pa.RecordBatch:
        part = every if columns is None else every[:, columns]
        xyz = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1], pa.array(part.ravel()))
        return pa.RecordBatch.from_arrays([pa.array([file] * len(part)), pa.array(np.arange(first, first + len(part), dtype=np.int32)), xyz], ["file", "frame", "xyz"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, size, start, stop in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                checked(file, size)
                with seekable(file) as f:
                    f.seek(start * 4 * width)
                    for at in range(start, stop, at_once):
                        n = min(at_once, stop - at)
                        yield rows(file, at, np.frombuffer(read_exactly(f, n * 4 * width), dtype="<f4").reshape(n, width))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = content.as_buffer()
                checked(file, raw.size)
                every = np.frombuffer(raw, dtype="<f4").reshape(-1, width)
                for at in range(0, len(every), at_once):
                    yield rows(file, at, every[at : at + at_once])

    files = listed(spark, path)
    if not all_seekable(files):
        return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(whole, F32_SCHEMA)
    each = max(1, task_bytes // (4 * width))
    n = F.ceil(F.col("length") / (4 * width))  # a broken frame at the end makes its task raise
    parts = F.ceil(n / each)
    tasks = files.agg(F.sum(parts)).first()[0] or 1
    spans = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("k"))
    spans = spans.select("path", "length", (F.col("k") * each).alias("start"), F.least((F.col("k") + 1) * each, n).alias("stop"))
    return spread(spans, tasks).mapInArrow(ranges, F32_SCHEMA)


def write_f32(path: str, frames: np.ndarray) -> None:
    Path(path).write_bytes(np.asarray(frames, dtype="<f4").tobytes())


def long_frames(frames: DataFrame, xyz: str = "xyz", keys: tuple[str, ...] = ("traj_id", "frame")) -> DataFrame:
    """keys, atom, x, y, z: one row for each atom of each frame."""
    n = F.size(xyz) / 3
    triples = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.struct(*[F.get(xyz, i * 3 + k).cast("double").alias(c) for k, c in enumerate("xyz")]))
    return frames.select(*keys, F.posexplode(triples).alias("atom", "p")).select(*keys, "atom", "p.x", "p.y", "p.z")


def write_dcd(path: str, xyz_angstrom: np.ndarray, box_angstrom: np.ndarray | None = None) -> None:
    """A CHARMM-style DCD file of (frames, atoms, 3) coordinates and (frames, 3) cubic or brick boxes."""
    xyz = np.asarray(xyz_angstrom, dtype="<f4")
    head = [len(xyz), 0, 1, len(xyz), 0, 0, 0, 0, 0, 0, int(box_angstrom is not None), *[0] * 8, 24]
    block = lambda b: struct.pack("<i", len(b)) + b + struct.pack("<i", len(b))
    with open(path, "wb") as f:
        f.write(block(b"CORD" + struct.pack("<20i", *head)))
        f.write(block(struct.pack("<i", 1) + b"frames".ljust(80)))
        f.write(block(struct.pack("<i", xyz.shape[1])))
        for k, frame in enumerate(xyz):
            if box_angstrom is not None:
                a, b, c = map(float, box_angstrom[k])
                f.write(block(struct.pack("<6d", a, 90.0, b, 90.0, 90.0, c)))
            for axis in range(3):
                f.write(block(np.ascontiguousarray(frame[:, axis]).tobytes()))


class DcdLayout:
    """Where a DCD file's frames lie: records of fixed size after three header blocks.

    Either byte order and record marks of 32 or 64 bits are read; files with fixed atoms, whose
    frames differ in size, raise.
    """

    def __init__(self, path: str):
        with seekable(path) as f:
            start = read_exactly(f, 12)
            kinds = [(order, mark) for order in "<>" for mark in "iq" if start[: struct.calcsize(mark)] == struct.pack(order + mark, 84) and start[struct.calcsize(mark) :][:4] == b"CORD"]
            if not kinds:
                raise ValueError(f"{path} is no DCD file")
            self.order, mark = kinds[0]
            self.mark = struct.calcsize(mark)
            f.seek(0)
            head, _, count = (self._block(f, mark) for _ in range(3))
            flags = struct.unpack_from(self.order + "20i", head, 4)
            self.has_box = flags[10] == 1
            if flags[8]:
                raise ValueError(f"{path} has {flags[8]} fixed atoms")
            self.n_atoms = struct.unpack(self.order + "i", count[:4])[0]
            self.first = f.tell()
            f.seek(0, 2)
            end = f.tell()
        self.box_bytes = (48 + 2 * self.mark) * self.has_box
        self.axis = 4 * self.n_atoms + 2 * self.mark
        self.frame_bytes = self.box_bytes + 3 * self.axis
        self.n_frames = (end - self.first) // self.frame_bytes

    def _block(self, f, mark: str) -> bytes:
        body = read_exactly(f, struct.unpack(self.order + mark, read_exactly(f, self.mark))[0])
        read_exactly(f, self.mark)
        return body

    def frames(self, path: str, wanted: range, atoms: np.ndarray | None = None, at_once: int = 64) -> Iterator[tuple[range, np.ndarray | None, np.ndarray]]:
        """(frames, boxes, xyz) of some frames at a time, in the file's angstrom; xyz is (frames, atoms, 3).

        Only wanted frames are read and, of each axis, only the stretch from the first to the last wanted atom,
        where that leaves out more than half.
        """
        lo, hi = (0, self.n_atoms) if atoms is None or not len(atoms) else (int(atoms.min()), int(atoms.max()) + 1)
        narrow = 2 * (hi - lo) < self.n_atoms
        lo, hi = (lo, hi) if narrow else (0, self.n_atoms)
        with seekable(path) as f:
            for k in range(0, len(wanted), at_once):
                some = wanted[k : k + at_once]
                box, xyz = np.empty((len(some), 3)), np.empty((len(some), 3, hi - lo), dtype=np.float32)
                for i, raw in enumerate(self._raw(f, some, narrow, lo, hi)):
                    if self.has_box:
                        box[i] = np.frombuffer(raw[0], dtype=self.order + "f8")[[0, 2, 5]]
                    for a in range(3):
                        xyz[i, a] = np.frombuffer(raw[1 + a], dtype=self.order + "f4")
                picked = xyz if atoms is None else xyz[:, :, np.asarray(atoms, dtype=np.int64) - lo]
                yield some, box if self.has_box else None, np.ascontiguousarray(picked.transpose(0, 2, 1))

    def _raw(self, f, some: range, narrow: bool, lo: int, hi: int) -> Iterator[tuple[bytes, ...]]:
        """Of each frame the bytes of the cell's edges and of the three axes' atoms lo to hi."""
        at = lambda a: self.box_bytes + a * self.axis + self.mark
        if narrow:
            for k in some:
                base, parts = self.first + k * self.frame_bytes, [b""]
                if self.has_box:
                    f.seek(base + self.mark)
                    parts = [read_exactly(f, 48)]
                for a in range(3):
                    f.seek(base + at(a) + 4 * lo)
                    parts.append(read_exactly(f, 4 * (hi - lo)))
                yield tuple(parts)
            return
        for k in some:
            if k == some[0] or some.step > 1:
                f.seek(self.first + k * self.frame_bytes)
            raw = read_exactly(f, self.frame_bytes)
            yield raw[self.mark : self.mark + 48], *(raw[at(a) : at(a) + 4 * self.n_atoms] for a in range(3))


class FrameRange(InputPartition):
    def __init__(self, path: str, start: int, stop: int, step: int = 1):
        self.path, self.start, self.stop, self.step = path, start, stop, step


class DcdReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = sorted(x for x in options["path"].split(",") if x)
        self.atoms = [int(x) for x in options.get("atoms", "").split(",") if x]  # none: all
        self.each = int(options.get("framesPerPartition", 256))
        self.interval = float(options.get("frameIntervalPs", 1.0))
        self.ids = options.get("trajId", "")
        part = [int(x) if x else None for x in options.get("frames", "").split(":")] + [None, None]
        self.chosen = slice(*part[:3])
        if (self.chosen.step or 1) < 1:
            raise ValueError("frames go forward: the step is at least 1")
        self.low, self.high = 0, None

    def _bound(self, low: int, high: int | None) -> None:
        self.low = max(self.low, low)
        self.high = high if self.high is None else self.high if high is None else min(self.high, high)

    def wanted(self, n_frames: int) -> range:
        """The chosen frames of a file within the bounds."""
        every = range(n_frames)[self.chosen]
        end = n_frames if self.high is None else max(0, min(self.high, n_frames))
        skip = max(0, -(-(self.low - every.start) // every.step))
        return range(every.start + skip * every.step, min(every.stop, end), every.step)

    def partitions(self) -> list[FrameRange]:
        out = []
        for path in self.paths:
            every = self.wanted(DcdLayout(path).n_frames)
            parts = [every[k : k + self.each] for k in range(0, len(every), self.each)]
            out += [FrameRange(path, p.start, p.stop, p.step) for p in parts]
        return out or [FrameRange("", 0, 0)]

    def read(self, partition: FrameRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        layout = DcdLayout(partition.path)
        name = self.ids or Path(partition.path).stem
        atoms = np.array(self.atoms, dtype=np.int64) if self.atoms else None
        for some, box, xyz in layout.frames(partition.path, range(partition.start, partition.stop, partition.step), atoms):
            n = len(xyz)
            frame = np.array(some, dtype=np.int32)
            flat = (xyz.astype(np.float64) / 10).astype(np.float32).reshape(n, -1)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            boxes = pa.nulls(n, pa.list_(pa.float64())) if box is None else lists(box / 10)
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(frame), pa.array(frame * self.interval), boxes, lists(flat)], ["traj_id", "frame", "time_ps", "box_nm", "xyz_nm"])


class PushingDcdReader(DcdReader):
    """A reader that takes comparisons of `frame` with numbers into the ranges it reads; Spark must allow it for the session."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of the frame number are taken into the ranges that are read; all other filters are Spark's."""
        for x in filters:
            value = getattr(x, "value", None)
            if getattr(x, "attribute", None) != ("frame",) or isinstance(value, bool) or not isinstance(value, int):
                yield x
            elif isinstance(x, EqualTo):
                self._bound(value, value + 1)
            elif isinstance(x, (GreaterThan, GreaterThanOrEqual)):
                self._bound(value + isinstance(x, GreaterThan), None)
            elif isinstance(x, (LessThan, LessThanOrEqual)):
                self._bound(0, value + isinstance(x, LessThanOrEqual))
            else:
                yield x


class DcdDataSource(DataSource):
    """spark.read.format("dcd"): options path (comma-separated), atoms (ordinals kept at the source, in that order), frames
    (start:stop:step), frameIntervalPs, framesPerPartition, trajId, pushdown.

    DCD stores angstrom; rows are in nanometres. A DCD file's own times are not trusted:
    time is the frame number times frameIntervalPs (1 ps unless given). With pushdown=true comparisons of `frame` with
    numbers narrow the ranges that are read, which needs spark.sql.python.filterPushdown.enabled (`read_dcd` sets both).
    Paths may name remote stores that Arrow opens.
    """

    @classmethod
    def name(cls) -> str:
        return "dcd"

    def schema(self) -> str:
        return DCD_SCHEMA

    def reader(self, schema) -> DcdReader:
        return (PushingDcdReader if self.options.get("pushdown") == "true" else DcdReader)(self.options)


def read_dcd(spark: SparkSession, path: str, atoms: list[int] | None = None, interval_ps: float = 1.0, traj_id: str = "", frames: str = "") -> DataFrame:
    """Rows of DCD_SCHEMA; frames: start:stop:step of each file."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DcdDataSource)
    options = {"path": path, "frameIntervalPs": str(interval_ps), "trajId": traj_id, "frames": frames, "pushdown": "true"}
    if atoms is not None:
        options["atoms"] = ",".join(map(str, atoms))
    return spark.read.format("dcd").options(**options).load()
