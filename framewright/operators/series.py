"""Ordered series: unwrapping, walks, mean squared displacement, the diffusive clock, radius of gyration.

Positions are rows (traj_id, tracer, frame, time_ps, box, x, y, z), or frames with the flat places of all tracers.
Lag sums run on blocks of tracers and, for long trajectories, time ranges; only (lag, count, sum) rows leave them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.scalars import minimum_image
from framewright.functions.work import written

AXES = ("x", "y", "z")
MOST_TRACERS, MOST_LAGS, SEED = 1000, 40, 20260819
FEWEST_TRACERS, FEWEST_FRAMES = 100, 5


def sample_tracers(atoms: list[int], most: int = MOST_TRACERS, seed: int = SEED) -> list[int]:
    """All atoms, or a seeded choice of `most` of them, in order."""
    return list(atoms) if len(atoms) <= most else sorted(np.random.default_rng(seed).choice(np.asarray(atoms), most, replace=False).tolist())


def steps(positions: DataFrame, keys: tuple[str, ...] = ("traj_id", "tracer")) -> DataFrame:
    """Minimum-image steps dx, dy, dz from the frame before; a tracer's first frame has none.

    The box is the first edge of the later frame, for all three axes (cubic cells).
    """
    w = Window.partitionBy(*keys).orderBy("frame")
    step = {f"d{a}": minimum_image(F.col(a) - F.lag(a).over(w), F.col("box")) for a in AXES}
    return positions.withColumns(step).where(F.col("dx").isNotNull())


def walks(positions: DataFrame, keys: tuple[str, ...] = ("traj_id", "tracer")) -> DataFrame:
    """Accumulated steps wx, wy, wz of each tracer."""
    w = Window.partitionBy(*keys).orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps(positions, keys).withColumns({f"w{a}": F.sum(f"d{a}").over(w) for a in AXES})


#: Tracers of a block, and frames of a time range: what one task holds is some ten times 24 bytes times both.
BLOCK, RANGE = 16, 8_192
_DEALT = "traj_id string, b long, frame long, box double, at array<int>, xyz array<double>, width int"
_SUMS = "traj_id string, lag int, n long, total double"


def lags_for(n: int, most: int = MOST_LAGS) -> list[int]:
    """The lag grid of a trajectory of n frames, ascending; none for fewer than three."""
    if n < 3:
        return []
    top = max(2, (n - 1) // 5)
    points = min(most, top)
    return sorted({*(1 + np.arange(points) * ((top - 1) / (points - 1))).astype(int).clip(max=top).tolist(), top})


def dealt_frames(frames: DataFrame, tracers: str = "tracer_nm") -> DataFrame:
    """Frame rows (traj_id, frame, box, tracers: flat xyz) as one row for each block of tracers."""
    size = F.size(tracers)
    spans = F.transform(F.sequence(F.lit(0), ((size - 1) / (3 * BLOCK)).cast("int")), lambda b: F.struct(b.cast("long").alias("b"), F.slice(tracers, b * 3 * BLOCK + 1, F.lit(3 * BLOCK)).cast("array<double>").alias("xyz")))
    rows = frames.where(size > 0).select("traj_id", F.col("frame").cast("long").alias("frame"), F.col("box").cast("double").alias("box"), F.explode(spans).alias("s"))
    return rows.select("traj_id", "s.b", "frame", "box", F.lit(None).cast("array<int>").alias("at"), "s.xyz", (F.size("s.xyz") / 3).cast("int").alias("width"))


def dealt_positions(positions: DataFrame) -> DataFrame:
    """The same from rows (traj_id, tracer, frame, box, x, y, z); tracers may be missing in frames."""
    each = positions.select("traj_id", "tracer").distinct()
    most = each.groupBy("traj_id").count().agg(F.max("count")).first()[0] or 0
    blocked = each.withColumn("b", F.pmod(F.xxhash64("tracer"), F.lit(max(1, -(-most // BLOCK)))))
    w = Window.partitionBy("traj_id", "b")
    placed = blocked.select("traj_id", "tracer", "b", (F.row_number().over(w.orderBy("tracer")) - 1).cast("int").alias("i"), F.count("*").over(w).cast("int").alias("width"))
    rows = positions.join(placed, ["traj_id", "tracer"]).groupBy("traj_id", "b", "frame").agg(F.first("box").alias("box"), F.array_sort(F.collect_list(F.struct("i", "x", "y", "z"))).alias("p"), F.first("width").alias("width"))
    flat = F.flatten(F.transform("p", lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"), p["z"].cast("double"))))
    return rows.select("traj_id", "b", F.col("frame").cast("long").alias("frame"), F.col("box").cast("double").alias("box"), F.col("p.i").alias("at"), flat.alias("xyz"), "width")


def _places(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Boxes (frames) and positions (frames, tracers, 3) in frame order, NaN where a tracer is missing."""
    part = part.sort_by("frame").combine_chunks()
    width, rows = part["width"][0].as_py(), part.num_rows
    flat = part["xyz"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    if flat.size == 3 * width * rows and part["at"].null_count == rows:
        return part["box"].to_numpy(), flat.reshape(rows, width, 3)
    out = np.full((rows, width, 3), np.nan)
    at, n = part["at"].combine_chunks(), pc.list_value_length(part["xyz"]).to_numpy() // 3
    columns = at.flatten().to_numpy() if at.null_count == 0 else np.concatenate([np.arange(k) for k in n.tolist()])
    out[np.repeat(np.arange(rows), n), columns] = flat.reshape(-1, 3)
    return part["box"].to_numpy(), out


def _near(gap: np.ndarray, box: np.ndarray) -> np.ndarray:
    return gap - box * np.rint(gap / box)


def _pair_sum(early: np.ndarray, late: np.ndarray) -> tuple[int, float]:
    """Pairs of tracers that are there both times, and the sum of their squared displacements."""
    square = np.square(late - early).sum(axis=2)
    there = np.isfinite(square)
    return int(there.sum()), float(square[there].sum())


def _ends(walk: np.ndarray, closing: np.ndarray) -> tuple[int, float]:
    """Tracers whose walk ends here and their squared displacements: where it breaks off, or at the last place if `closing`."""
    there = np.isfinite(walk[:, :, 0])
    last = len(walk) - 1 - np.argmax(there[::-1], axis=0)
    done = there.any(axis=0) & (~there[-1] | closing)
    square = np.square(walk[last, np.arange(walk.shape[1])]).sum(axis=1)[done]
    return len(square), float(square.sum())


def _sum_rows(traj: str, rows: list[tuple[int, int, float]]) -> pa.Table:
    lag, n, total = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"traj_id": pa.array([traj] * len(rows), pa.string()), "lag": pa.array(lag, pa.int32()), "n": pa.array(n, pa.int64()), "total": pa.array(total, pa.float64())})


def _whole(dealt: DataFrame, sizes: DataFrame | None, most: int) -> DataFrame:
    """Lag sums with all frames of a block of tracers in one task; without sizes each block has its trajectory's every frame."""

    every = sizes is None

    def run(key: tuple, part: pa.Table) -> pa.Table:
        traj, n = key[0].as_py(), part.num_rows if every else part["n_frames"][0].as_py()
        box, xyz = _places(part)
        walk = np.cumsum(_near(np.diff(xyz, axis=0), box[1:, None, None]), axis=0)
        rows = [(0, *_ends(walk, np.ones(walk.shape[1], dtype=bool)))] if len(walk) else []
        return _sum_rows(traj, rows + [(k, *_pair_sum(walk[:-k], walk[k:])) for k in lags_for(n, most) if k < len(walk)])

    rows = dealt if every else dealt.join(sizes, "traj_id")
    return rows.groupBy("traj_id", "b").applyInArrow(run, _SUMS)


def _edges(key: tuple, part: pa.Table) -> pa.Table:
    """A range's first and last places, the box of its first frame and its net displacement."""
    box, xyz = _places(part)
    net = _near(np.diff(xyz, axis=0), box[1:, None, None]).sum(axis=0)
    cells = {"traj_id": key[0].as_py(), "b": key[1].as_py(), "part": key[2].as_py(), "n": len(xyz), "n_frames": part["n_frames"][0].as_py(), "box": float(box[0]), "first": xyz[0].tobytes(), "last": xyz[-1].tobytes(), "net": net.tobytes()}
    return pa.Table.from_pylist([cells])


def _carried(most: int):
    """For each range: the walk at its first frame, its frames' numbers, whose walks end with it, and the earlier ranges that need it."""
    schema = pa.schema([("traj_id", pa.string()), ("b", pa.int64()), ("part", pa.int64()), ("g", pa.int64()), ("n_frames", pa.int64()), ("start", pa.binary()), ("closing", pa.binary()), ("needs", pa.list_(pa.int64()))])

    def run(part: pa.Table) -> pa.Table:
        rows = part.sort_by("part").to_pylist()
        read = lambda r, c: np.frombuffer(r[c]).reshape(-1, 3)
        lags, out = lags_for(rows[0]["n_frames"], most) if rows else [], []
        g = np.concatenate([[0], np.cumsum([r["n"] for r in rows])])
        at = None
        for i, r in enumerate(rows):
            start = np.where(np.isfinite(read(r, "first")), 0.0, np.nan) if at is None else at + _near(read(r, "first") - read(rows[i - 1], "last"), r["box"])
            at = start + read(r, "net")
            closing = ~np.isfinite(read(rows[i + 1], "first")[:, 0]) if i + 1 < len(rows) else np.ones(len(at), dtype=bool)
            needs = {i}
            for k in lags:  # frame 0 has made no step: pairs are of frames from 1 on
                lo, hi = max(1, g[i] - k), g[i + 1] - k
                if lo < hi:
                    needs.update(range(int(np.searchsorted(g, lo, "right")) - 1, int(np.searchsorted(g, hi - 1, "right"))))
            out.append({"traj_id": r["traj_id"], "b": r["b"], "part": r["part"], "g": int(g[i]), "n_frames": r["n_frames"], "start": start.tobytes(), "closing": closing.tobytes(), "needs": [rows[e]["part"] for e in sorted(needs)]})
        return pa.Table.from_pylist(out, schema)

    return run


def _walked(part: pa.Table, carry: pa.Table) -> pa.Table:
    """A range's walk, and the ranges that need it: itself and earlier ones."""
    schema = pa.schema([("traj_id", pa.string()), ("b", pa.int64()), ("needs", pa.list_(pa.int64())), ("own", pa.int64()), ("g", pa.int64()), ("n_frames", pa.int64()), ("width", pa.int32()), ("n", pa.int64()), ("total", pa.float64()), ("walk", pa.binary())])
    if not part.num_rows or not carry.num_rows:
        return schema.empty_table()
    c = carry.to_pylist()[0]
    box, xyz = _places(part)
    steps = _near(np.diff(xyz, axis=0), box[1:, None, None])
    walk = np.concatenate([np.frombuffer(c["start"]).reshape(1, -1, 3), steps]).cumsum(axis=0)
    g = c["g"]
    if not g:
        walk, g = walk[1:], 1
    n, total = _ends(walk, np.frombuffer(c["closing"], dtype=bool)) if len(walk) else (0, 0.0)
    cells = [c["traj_id"], c["b"], c["needs"], c["part"], g, c["n_frames"], xyz.shape[1], n, total, np.ascontiguousarray(walk).tobytes()]
    return pa.table([pa.array([x], f.type) for x, f in zip(cells, schema, strict=True)], schema=schema)


def _met(most: int):
    """Lag sums of ranges against the ranges that hold their frames a lag later; rows come by (traj_id, b, early), the range itself first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        early, base, lags = np.zeros((0, 0, 3)), 0, []
        for batch in batches:
            for traj, e, own, g, n_frames, width, n, total, body in zip(*(batch.column(k) for k in (0, 2, 3, 4, 5, 6, 7, 8, 9)), strict=True):
                late, at = np.frombuffer(body.as_buffer()).reshape(-1, width.as_py(), 3), g.as_py()
                rows = []
                if own.as_py() == e.as_py():
                    early, base, lags = late.copy(), at, lags_for(n_frames.as_py(), most)
                    rows.append((0, n.as_py(), total.as_py()))
                for k in lags:
                    lo, hi = max(base, at - k), min(base + len(early), at + len(late) - k)
                    if lo < hi:
                        rows.append((k, *_pair_sum(early[lo - base : hi - base], late[lo + k - at : hi + k - at])))
                if rows:
                    yield _sum_rows(traj.as_py(), rows).combine_chunks().to_batches()[0]

    return run


def _ranged(dealt: DataFrame, sizes: DataFrame, most: int, length: int) -> DataFrame:
    """Lag sums over time ranges of `length` frame numbers: a scan over the ranges' edges carries the walk on, then ranges meet those a lag later."""
    rows = dealt.join(sizes, "traj_id").withColumn("part", F.floor(F.col("frame") / length))
    edges = rows.groupBy("traj_id", "b", "part").applyInArrow(_edges, "traj_id string, b long, part long, n long, n_frames long, box double, first binary, last binary, net binary")
    carry = edges.groupBy("traj_id", "b").applyInArrow(_carried(most), "traj_id string, b long, part long, g long, n_frames long, start binary, closing binary, needs array<long>")
    keys = ("traj_id", "b", "part")
    fresh = carry.select(*[F.col(c).alias(f"_{c}") for c in keys], *[c for c in carry.columns if c not in keys])

    def walked(part: pa.Table, carry: pa.Table) -> pa.Table:
        return _walked(part, carry.rename_columns([c.removeprefix("_") for c in carry.column_names]))

    walks_ = rows.groupBy(*keys).cogroup(fresh.groupBy(*[f"_{c}" for c in keys])).applyInArrow(walked, "traj_id string, b long, needs array<long>, own long, g long, n_frames long, width int, n long, total double, walk binary")
    sent = walks_.select("traj_id", "b", F.explode("needs").alias("early"), *walks_.columns[3:])
    laid = sent.repartition("traj_id", "b", "early").sortWithinPartitions("traj_id", "b", "early", F.col("own") != F.col("early"), "own")
    return laid.mapInArrow(_met(most), _SUMS)


def lag_sums(dealt: DataFrame, most: int = MOST_LAGS, length: int = RANGE, longest: int | None = None) -> DataFrame:
    """traj_id, lag (0: the whole walk), n, total of dealt frames: parts of the sums of squared displacements.

    A tracer counts from frame 0 until it is first missing. Trajectories of up to `length` frames go through one task for
    each block of tracers; longer ones through time ranges, so a task's memory is set by the range. longest: frames of
    the longest trajectory, if known, and then every block of a trajectory has all its frames.
    """
    if longest is not None and longest <= length:
        return _whole(dealt, None, most)
    counted = lambda rows: rows.groupBy("traj_id").agg(F.count_distinct("frame").alias("n_frames"))
    sizes = counted(dealt)
    if not sizes.where(F.col("n_frames") > length).take(1):
        return _whole(dealt, sizes, most)
    dealt = written(dealt, "dealt-frames")  # read by each of the passes below
    sizes = written(counted(dealt), "trajectory-sizes")
    long = sizes.where(F.col("n_frames") > length)
    return _whole(dealt, sizes.where(F.col("n_frames") <= length), most).union(_ranged(dealt, long, most, length))


def walk_sums(frames: DataFrame, tracers: str = "tracer_nm", most: int = MOST_LAGS, longest: int | None = None) -> DataFrame:
    """lag_sums of frame rows (traj_id, frame, box, tracers: flat xyz)."""
    return lag_sums(dealt_frames(frames, tracers), most, longest=longest)


def msd_of(sums: DataFrame) -> DataFrame:
    """traj_id, lag, msd: mean over origins and tracers; lag 0 is the whole walk's."""
    return sums.groupBy("traj_id", "lag").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("msd"))


def fitted_clock(msd: DataFrame, dt: DataFrame) -> DataFrame:
    """traj_id, slope, total, elapsed_ps: the time that diffusion at the fitted rate takes for the whole walk. dt: traj_id, dt."""
    fits = dt.join(msd, "traj_id").groupBy("traj_id").agg(F.regr_slope(F.when(F.col("lag") > 0, F.col("msd")), F.col("lag") * F.col("dt")).alias("slope"), F.max(F.when(F.col("lag") == 0, F.col("msd"))).alias("total"))
    return fits.withColumn("elapsed_ps", F.when(F.col("slope") > 0, F.col("total") / F.col("slope")).otherwise(0.0))


def facts(frames: DataFrame, tracers: str = "tracer_nm") -> DataFrame:
    """traj_id, n_frames, n_tracers, dt: the time between the first two frames."""
    got = frames.groupBy("traj_id").agg(
        F.count("*").alias("n_frames"),
        F.max((F.greatest(F.coalesce(F.size(tracers), F.lit(0)), F.lit(0)) / 3).cast("int")).alias("n_tracers"),
        F.array_sort(F.array_agg(F.when(F.col("frame") < 2, F.struct("frame", "time_ps")))).alias("t"),
    )
    time = lambda i: F.get("t", F.lit(i))["time_ps"]
    return got.select("traj_id", "n_frames", "n_tracers", (time(1) - time(0)).alias("dt"))


def guard(n_tracers: Column, n_frames: Column) -> Column:
    """Why a trajectory's clock can't be read, or null."""
    return F.when(n_tracers < FEWEST_TRACERS, F.format_string("only %d solvent atoms", n_tracers)).when(n_frames < FEWEST_FRAMES, F.format_string("only %d frames", n_frames))


def clocks(frames: DataFrame, tracers: str = "tracer_nm", most: int = MOST_LAGS, longest: int | None = None) -> DataFrame:
    """Elapsed time by diffusion for each trajectory (traj_id, frame, time_ps, box, tracer_nm: flat xyz).

    measurable, reason, elapsed_ps, total_msd_nm2, diffusion_1e5_cm2_s, frame_interval_ps, n_tracers.
    """
    known = facts(frames, tracers)
    fits = fitted_clock(msd_of(walk_sums(frames, tracers, most, longest)), known.select("traj_id", "dt"))
    out = known.join(fits, "traj_id", "left").withColumn("reason", guard(F.col("n_tracers"), F.col("n_frames")))
    ok = F.col("reason").isNull()
    return out.select(
        "traj_id",
        ok.alias("measurable"),
        "reason",
        F.when(ok, F.col("elapsed_ps")).alias("elapsed_ps"),
        F.when(ok, F.col("total")).alias("total_msd_nm2"),
        F.when(ok, F.col("slope") / 6 * 1e3).alias("diffusion_1e5_cm2_s"),
        F.when(ok, F.col("dt")).alias("frame_interval_ps"),
        "n_tracers",
    )


def radii_of_gyration(frames: DataFrame, xyz: str = "protein_nm") -> DataFrame:
    """traj_id, frame, rg: root mean square distance from the centre, all atoms alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rg = []
            for v in b.column(2).to_pylist():
                x = np.asarray(v, dtype=np.float64).reshape(-1, 3) if v else None
                rg.append(None if x is None else float(np.sqrt(np.square(x - x.mean(axis=0)).sum(axis=1).mean())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rg, pa.float64())], ["traj_id", "frame", "rg"])

    return frames.select("traj_id", F.col("frame").cast("int").alias("frame"), xyz).mapInArrow(run, "traj_id string, frame int, rg double")


def radii_of_gyration_long(atoms: DataFrame, keys: tuple[str, ...] = ("traj_id", "frame")) -> DataFrame:
    """The same from one row for each atom."""
    return atoms.groupBy(*keys).agg(F.sqrt(sum(F.var_pop(a) for a in AXES)).alias("rg"))
