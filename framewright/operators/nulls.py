"""Elastic-network and random null models of subspace agreement, and the tests against them."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from framewright.functions.work import written

from .linalg import MODES, correlations, rmsip, summed

TEST_ID = "subspace_beyond_structure@1"
LEGACY_TEST_ID = "subspace_unrelated@1"
CONTRACT_ID = "pca_backbone_subspace@1"
#: Network cutoffs of 7.0 to 20.0 angstrom, every half.
CUTOFFS = tuple(7.0 + 0.5 * i for i in range(27))
SEED = 20260819
DRAWS = 20_000
ALPHA = 1e-3


def hessian(coords: np.ndarray, cutoff: float) -> np.ndarray:
    """Anisotropic network with unit springs between sites up to the cutoff (inclusive); coincident sites do not touch."""
    n = len(coords)
    gap = coords[:, None] - coords[None]
    square = np.einsum("ijk,ijk->ij", gap, gap)
    touch = (square > 0) & (square <= cutoff * cutoff)
    unit = np.where(touch[..., None], gap / np.sqrt(np.where(square > 0, square, 1.0))[..., None], 0.0)
    out = np.empty((n, 3, n, 3))
    for a in range(3):
        for b in range(3):
            pair = unit[..., a] * unit[..., b]
            out[:, a, :, b] = np.diag(pair.sum(axis=1)) - pair
    return out.reshape(3 * n, 3 * n)


#: Up to so many sites the network's Hessian is diagonalised as a dense matrix.
DENSE_SITES = 1000


def touching(coords: np.ndarray, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sites (i < j) with 0 < distance <= cutoff, from cells of the cutoff's width; memory follows the pairs."""
    cell = np.floor((coords - coords.min(axis=0)) / cutoff).astype(np.int64) + 1
    wide = cell.max(axis=0) + 2
    key = (cell[:, 0] * wide[1] + cell[:, 1]) * wide[2] + cell[:, 2]
    order = np.argsort(key, kind="stable")
    ranked, left, right = key[order], [], []
    half = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) >= (0, 0, 0)]
    for x, y, z in half:
        near = key + (x * wide[1] + y) * wide[2] + z
        lo, hi = np.searchsorted(ranked, near, "left"), np.searchsorted(ranked, near, "right")
        n = hi - lo
        i = np.repeat(np.arange(len(coords)), n)
        j = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        keep = (i < j) if (x, y, z) == (0, 0, 0) else np.ones(len(i), dtype=bool)
        square = np.square(coords[i[keep]] - coords[j[keep]]).sum(axis=1)
        close = (square > 0) & (square <= cutoff * cutoff)
        left.append(np.minimum(i[keep][close], j[keep][close]))
        right.append(np.maximum(i[keep][close], j[keep][close]))
    return np.concatenate(left), np.concatenate(right)


def levels(n: int, i: np.ndarray, j: np.ndarray) -> list[list[np.ndarray]]:
    """For each connected piece its sites by distance (in contacts) from one end; only neighbouring levels touch."""
    every = np.concatenate([i, j])
    order = np.argsort(every, kind="stable")
    ends, first = np.concatenate([j, i])[order], np.searchsorted(every[order], np.arange(n + 1))
    seen, pieces = np.zeros(n, dtype=bool), []

    def spread(start: int, fresh: np.ndarray) -> list[np.ndarray]:
        front, out = np.array([start]), []
        fresh[start] = False
        while len(front):
            out.append(front)
            near = np.unique(np.concatenate([ends[first[s] : first[s + 1]] for s in front.tolist()]))
            front = near[fresh[near]]
            fresh[front] = False
        return out

    for start in range(n):
        if not seen[start]:
            far = spread(start, ~seen)[-1][-1]  # an end of the piece gives more and smaller levels
            pieces.append(spread(int(far), ~seen))
            seen[np.concatenate(pieces[-1])] = True
    return pieces


class SparseNetwork:
    """The network's Hessian as pairs and unit vectors, and its shifted inverse by block elimination along levels."""

    def __init__(self, coords: np.ndarray, cutoff: float, shift: float = 1e-6):
        self.n = len(coords)
        self.i, self.j = touching(coords, cutoff)
        gap = coords[self.i] - coords[self.j]
        self.unit = gap / np.sqrt(np.square(gap).sum(axis=1))[:, None]
        self.pieces = levels(self.n, self.i, self.j)
        self.shift = shift
        self.sites = [level for piece in self.pieces for level in piece]
        order = np.concatenate(self.sites)
        self.level, self.place = np.empty(self.n, dtype=np.int64), np.empty(self.n, dtype=np.int64)
        self.level[order] = np.repeat(np.arange(len(self.sites)), [len(s) for s in self.sites])
        self.place[order] = np.concatenate([np.arange(len(s)) for s in self.sites])
        self._eliminate()

    def times(self, x: np.ndarray) -> np.ndarray:
        """H x for x (3n, k)."""
        y = x.reshape(self.n, 3, -1)
        out = np.zeros_like(y)
        for k in range(y.shape[2]):
            f = ((y[self.i, :, k] - y[self.j, :, k]) * self.unit).sum(axis=1)[:, None] * self.unit
            for a in range(3):
                out[:, a, k] = np.bincount(self.i, f[:, a], self.n) - np.bincount(self.j, f[:, a], self.n)
        return out.reshape(x.shape)

    def _eliminate(self) -> None:
        """Inverse of each level's block once the levels before it are eliminated, and the coupling to the level before."""
        blocks = np.einsum("pi,pj->pij", self.unit, self.unit)
        same = self.level[self.i] == self.level[self.j]
        self.inverse, self.below = [], []
        diagonal = np.zeros((self.n, 3, 3))
        for a in range(3):
            for b in range(3):
                diagonal[:, a, b] = np.bincount(self.i, blocks[:, a, b], self.n) + np.bincount(self.j, blocks[:, a, b], self.n)
        of = np.minimum(self.level[self.i], self.level[self.j])
        order = np.argsort(of, kind="stable")
        first = np.searchsorted(of[order], np.arange(len(self.sites) + 1))
        coupling = None
        for k, sites in enumerate(self.sites):
            m = len(sites)
            d = np.zeros((m, 3, m, 3))
            at = np.arange(m)
            d[at, :, at, :] = diagonal[sites] + np.eye(3) * self.shift
            pairs = order[first[k] : first[k + 1]]
            own = pairs[same[pairs]]
            d[self.place[self.i[own]], :, self.place[self.j[own]], :] = -blocks[own]
            d[self.place[self.j[own]], :, self.place[self.i[own]], :] = -blocks[own]
            d = d.reshape(3 * m, 3 * m)
            if coupling is not None:
                d -= coupling @ self.inverse[-1] @ coupling.T
            self.below.append(coupling)
            self.inverse.append(np.linalg.inv((d + d.T) / 2))
            cross = pairs[~same[pairs]]
            coupling = None
            if len(cross):  # none after a piece's last level
                up = np.where(self.level[self.i[cross]] > self.level[self.j[cross]], self.i[cross], self.j[cross])
                down = self.i[cross] + self.j[cross] - up
                c = np.zeros((len(self.sites[k + 1]), 3, m, 3))
                c[self.place[up], :, self.place[down], :] = -blocks[cross]
                coupling = c.reshape(-1, 3 * m)

    def solve(self, x: np.ndarray) -> np.ndarray:
        """(H + shift)^-1 x for x (3n, k)."""
        y = x.reshape(self.n, 3, -1)
        parts = [y[s].reshape(3 * len(s), -1).copy() for s in self.sites]
        for k in range(1, len(parts)):
            if self.below[k] is not None:
                parts[k] -= self.below[k] @ (self.inverse[k - 1] @ parts[k - 1])
        for k in reversed(range(len(parts))):
            right = parts[k]
            if k + 1 < len(parts) and self.below[k + 1] is not None:
                right = right - self.below[k + 1].T @ parts[k + 1]
            parts[k] = self.inverse[k] @ right
        out = np.empty_like(y)
        for s, part in zip(self.sites, parts, strict=True):
            out[s] = part.reshape(len(s), 3, -1)
        return out.reshape(x.shape)


def _rigid(coords: np.ndarray) -> np.ndarray:
    """Orthonormal translations and rotations (3n, 6)."""
    x = coords - coords.mean(axis=0)
    moves = [np.tile(np.eye(3)[a], (len(x), 1)) for a in range(3)] + [np.cross(np.eye(3)[a], x) for a in range(3)]
    return np.linalg.qr(np.stack([m.ravel() for m in moves], axis=1))[0]


def sparse_modes(coords: np.ndarray, cutoff: float, n_modes: int = MODES, tolerance: float = 1e-10, most: int = 60) -> np.ndarray:
    """The lowest modes beyond the six rigid ones, by block Lanczos on the shifted inverse without its rigid part.

    Memory follows contacts and the squares of level sizes. Rayleigh-Ritz steps end when all residuals are below
    tolerance times the largest diagonal.
    """
    net, rigid = SparseNetwork(coords, cutoff), _rigid(coords)
    width = n_modes + 8
    clean = lambda x: x - rigid @ (rigid.T @ x)
    basis = np.linalg.qr(clean(np.random.default_rng(1).standard_normal((3 * net.n, width))))[0]
    block, whole, scale = basis, basis, 2.0 * max(1, len(net.i) // max(1, net.n))
    for _ in range(most):
        block = clean(net.solve(block))
        for _ in range(2):  # twice is enough
            block = clean(block - whole @ (whole.T @ block))
        block = np.linalg.qr(block)[0]
        whole = np.concatenate([whole, block], axis=1)
        image = net.times(whole)
        values, turn = np.linalg.eigh(whole.T @ image)
        best = whole @ turn[:, :n_modes]
        if np.sqrt(np.square(image @ turn[:, :n_modes] - best * values[:n_modes]).sum(axis=0)).max() <= tolerance * scale:
            return best
        if whole.shape[1] > 12 * width:  # starts again from what has been found
            whole = np.linalg.qr(whole @ turn[:, : 2 * width])[0]
            block = whole
    raise ArithmeticError(f"the lowest modes at cutoff {cutoff} did not settle in {most} steps")


def network_modes(coords: np.ndarray, cutoff: float, n_modes: int = MODES) -> np.ndarray:
    """The lowest modes beyond the six rigid ones."""
    if len(coords) > DENSE_SITES:
        return sparse_modes(coords, cutoff, n_modes)
    return np.linalg.eigh(hessian(coords, cutoff))[1][:, 6 : 6 + n_modes]


def network_components(coords: np.ndarray, cutoff: float) -> int:
    """Connected pieces of the network: beyond one, more than six modes are rigid."""
    return len(levels(len(coords), *touching(coords, cutoff)))


def network_null(spark: SparkSession, structures: DataFrame | dict[str, tuple[np.ndarray, np.ndarray]], cutoffs=CUTOFFS) -> DataFrame:
    """structure, at, cutoff, rmsip, pieces: each structure and cutoff is one row of work, dealt out evenly.

    structures: a table (structure, coords: flat, modes: array of modes), or coordinates (M, 3) and modes (3M, D) by name.
    """
    if isinstance(structures, dict):
        rows = [(k, np.asarray(x, dtype=np.float64).ravel().tolist(), np.asarray(m).T.tolist()) for k, (x, m) in structures.items()]
        structures = spark.createDataFrame(rows, "structure string, coords array<double>, modes array<array<double>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, flat, modes, i, cutoff in zip(*(b.column(k) for k in range(5)), strict=True):
                coords = flat.values.to_numpy(zero_copy_only=False).reshape(-1, 3)
                reference = modes.values.flatten().to_numpy(zero_copy_only=False).reshape(len(modes.values), -1).T
                value = rmsip(network_modes(coords, cutoff.as_py(), reference.shape[1]), reference)
                row = [pa.array([name.as_py()]), pa.array([i.as_py()], pa.int32()), pa.array([cutoff.as_py()]), pa.array([value]), pa.array([network_components(coords, cutoff.as_py())], pa.int32())]
                yield pa.RecordBatch.from_arrays(row, ["structure", "at", "cutoff", "rmsip", "pieces"])

    jobs = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(float(c)).alias("cutoff")) for i, c in enumerate(cutoffs)])
    each = structures.select("structure", "coords", "modes", F.explode(jobs).alias("job")).select("structure", "coords", "modes", "job.at", "job.cutoff")
    tasks = max(len(cutoffs), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return each.repartition(tasks).mapInArrow(run, "structure string, at int, cutoff double, rmsip double, pieces int")


def null_floor(null: DataFrame) -> DataFrame:
    """Largest RMSIP of each structure and its cutoff; among equals the first cutoff."""
    return null.groupBy("structure").agg(F.max("rmsip").alias("floor"), F.max_by("cutoff", F.struct("rmsip", -F.col("at"))).alias("best_cutoff"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("cutoff", "rmsip")))).alias("per_cutoff"))


def random_draws(dim: int, n_modes: int, draws: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Canonical correlations of pairs of random orthonormal frames."""
    for _ in range(draws):
        a, b = (np.linalg.qr(rng.standard_normal((dim, n_modes)))[0] for _ in range(2))
        yield correlations(a, b)


def random_null(spark: SparkSession, dim: int, n_modes: int, draws: int = DRAWS, seed: int = SEED, block: int | None = 250) -> DataFrame:
    """draw, rmsip, correlations. Blocks of draws have independent streams; block=None is one serial stream."""
    size = draws if block is None else block
    starts = list(range(0, draws, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                rng = np.random.default_rng(seed if block is None else np.random.SeedSequence(seed, spawn_key=(i,)))
                n = min(size, draws - i * size)
                got = np.array(list(random_draws(dim, n_modes, n, rng)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i * size, i * size + n)), pa.array(np.sqrt(np.square(got).sum(axis=1) / n_modes)), pa.array(got.tolist(), pa.list_(pa.float64()))], ["draw", "rmsip", "correlations"])

    return spark.range(0, len(starts), 1, min(len(starts), 256)).mapInArrow(run, "draw long, rmsip double, correlations array<double>")


def random_overlaps(structures: DataFrame, draws: int, seed: int = SEED) -> DataFrame:
    """structure, draw, rmsip: each subspace (structure, modes: array of modes) against random frames of its own size.

    A structure's draws come from a stream of its own, seeded by its name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, modes in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = modes.values.flatten().to_numpy(zero_copy_only=False).reshape(len(modes.values), -1).T
                rng = np.random.default_rng([seed, zlib.crc32(name.encode())])
                got = [rmsip(np.linalg.qr(rng.standard_normal(own.shape))[0], own) for _ in range(draws)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * draws), pa.array(range(draws), pa.int64()), pa.array(got)], ["structure", "draw", "rmsip"])

    return structures.select("structure", "modes").mapInArrow(run, "structure string, draw long, rmsip double")


def unrelated_tests(pairs: DataFrame, alpha: float = ALPHA, draws: int = DRAWS, block: int | None = 250) -> DataFrame:
    """left, right, rmsip and the test of each pair (left, right, u, v: arrays of modes) against random frames of their size.

    All subspaces have one size; the null is drawn and summed up once, in a row that holds its `draws` values.
    """
    spark = pairs.sparkSession
    size = pairs.select(F.size("u").alias("n"), F.size(F.get("u", F.lit(0))).alias("dim")).distinct().limit(2).collect()
    if len(size) > 1:
        raise ValueError("subspaces of different sizes have different nulls")
    schema = "left string, right string, rmsip double, cosines array<double>"
    if not size:
        pairs, size = pairs.limit(0), [(1, 1)]
    n, dim = size[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = []
            for u, v in zip(b.column(2), b.column(3), strict=True):
                a, c = (m.values.flatten().to_numpy(zero_copy_only=False).reshape(len(m.values), -1) for m in (u, v))
                cells.append(correlations(a.T, c.T))
            values = pa.array([float(np.sqrt(np.square(x).sum() / n)) for x in cells], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), values, pa.array([x.tolist() for x in cells], pa.list_(pa.float64()))], ["left", "right", "rmsip", "cosines"])

    observed = pairs.select("left", "right", "u", "v").mapInArrow(run, schema)
    marks = F.array(*[F.percentile(F.get("correlations", F.lit(i)), 0.99) for i in range(n)])
    null = random_null(spark, dim, n, draws, block=block).agg(F.avg("rmsip").alias("null_mean"), F.stddev_pop("rmsip").alias("null_sd"), F.percentile("rmsip", 1.0 - alpha).alias("reject_threshold"), F.collect_list("rmsip").alias("_draws"), marks.alias("_marks"))
    got = observed.crossJoin(null)  # one row
    exceed = F.size(F.filter("_draws", lambda d: d >= F.col("rmsip")))
    above = F.size(F.filter(F.zip_with("cosines", "_marks", lambda c, m: c > m), lambda x: x))
    z = F.try_divide(F.col("rmsip") - F.col("null_mean"), F.col("null_sd"))
    return got.select("left", "right", F.lit(LEGACY_TEST_ID).alias("test_id"), "rmsip", "null_mean", "null_sd", "reject_threshold", z.alias("z_score"), ((exceed + 1) / (draws + 1)).alias("p_value_upper_bound"), above.alias("modes_above_null_99"), (F.col("rmsip") > F.col("reject_threshold")).alias("h0_rejected"))


def compared(null: DataFrame, observed: DataFrame, keys: list[str], value: str = "rmsip", draws_fit: bool = False) -> DataFrame:
    """observed (keys, observed) with the null's mean, population deviation, maximum, z, p bound and verdict (strictly beyond every draw).

    The null is summed up first, a row for each key, which meets the observed values. draws_fit: a key's draws (a
    sweep's cutoffs, or at most DRAWS) also go along in that row, to be counted against each observed value; otherwise draws and
    observed values are joined for the count.
    """
    x, cols = F.col(value), [c for c in observed.columns if c not in keys]
    facts = [F.avg(x).alias("null_mean"), F.stddev_pop(x).alias("null_sd"), F.max(x).alias("null_max"), F.count("*").alias("draws")]
    if draws_fit or not keys:
        summed = null.groupBy(*keys).agg(*facts, F.collect_list(x).alias("_draws"))
        got = observed.join(summed, keys) if keys else observed.crossJoin(summed)  # one row
        got = got.withColumn("exceed", F.size(F.filter("_draws", lambda d: d >= F.col("observed"))).cast("long"))
    else:
        counted = null.select(*keys, x).join(observed, keys).groupBy(*keys, *cols).agg(F.count_if(x >= F.col("observed")).alias("exceed"))
        got = counted.join(null.groupBy(*keys).agg(*facts), keys)
    z = F.try_divide(F.col("observed") - F.col("null_mean"), F.col("null_sd"))
    got = got.select(*keys, *cols, "null_mean", "null_sd", "null_max", "exceed", "draws")
    return got.withColumns({"z_score": z, "p_value_upper_bound": (F.col("exceed") + 1) / (F.col("draws") + 1), "h0_rejected": F.col("observed") > F.col("null_max")})


def test_beyond_structure(own: np.ndarray, reference: np.ndarray, null: DataFrame, context=None) -> dict:
    """Whether own modes agree with the reference beyond what the structure alone predicts.

    `null`: rmsip and cutoff rows. `context`: mean m and deviation s of the random null, drawn here if not given.
    """
    spark, cos = null.sparkSession, correlations(own, reference)
    observed = float(np.sqrt(np.square(cos).sum() / own.shape[1]))
    row = compared(null.select("rmsip"), spark.createDataFrame([(observed,)], "observed double"), []).first()
    if context is None:
        context = random_null(spark, own.shape[0], own.shape[1], 2000).agg(F.avg("rmsip").alias("m"), F.stddev_pop("rmsip").alias("s")).first()
    out = {"test_id": TEST_ID, "contract_id": CONTRACT_ID, "rmsip": observed, "canonical_correlations": cos.tolist()}
    out |= {k: row[k] for k in ("null_mean", "null_sd", "null_max", "z_score", "p_value_upper_bound", "h0_rejected")}
    out["null_cutoffs"] = sorted(r.cutoff for r in null.select("cutoff").collect())
    return out | {"context_random_null_mean": context.m, "context_random_null_z": (observed - context.m) / context.s if context.s else None}


def test_unrelated(spark: SparkSession, u: np.ndarray, v: np.ndarray, alpha: float = ALPHA, draws: int = DRAWS, block: int | None = 250) -> dict:
    """Whether two subspaces agree beyond random frames: above the null's 1 - alpha quantile."""
    dim, n = u.shape
    cos = correlations(u, v)
    observed = float(np.sqrt(np.square(cos).sum() / n))
    null = random_null(spark, dim, n, draws, block=block)
    marks = [F.percentile(F.col("correlations")[i], 0.99).alias(f"c{i}") for i in range(n)]
    row = null.agg(F.avg("rmsip").alias("mean"), F.stddev_pop("rmsip").alias("sd"), F.percentile("rmsip", 1.0 - alpha).alias("cut"), F.count_if(F.col("rmsip") >= observed).alias("exceed"), *marks).first()
    return {
        "test_id": LEGACY_TEST_ID,
        "contract_id": CONTRACT_ID,
        "n_modes": n,
        "dimension": dim,
        "rmsip": observed,
        "canonical_correlations": cos.tolist(),
        "null_mean": row["mean"],
        "null_sd": row["sd"],
        "null_analytic_mean": float(np.sqrt(n / dim)),
        "reject_threshold": row["cut"],
        "alpha": alpha,
        "z_score": (observed - row["mean"]) / row["sd"] if row["sd"] else None,
        "p_value_upper_bound": (row["exceed"] + 1) / (draws + 1),
        "modes_above_null_99": sum(float(cos[i]) > row[f"c{i}"] for i in range(n)),
        "h0_rejected": observed > row["cut"],
    }


for _f in (test_beyond_structure, test_unrelated):
    _f.__test__ = False  # statistical tests, not pytest's


def contacts(sites: DataFrame, cutoff: float) -> DataFrame:
    """Pairs of sites (structure, site, x, y, z) with 0 < distance <= cutoff, by an equi-join on grid cells of the cutoff's width."""
    cell = {f"c{a}": F.floor(F.col(a) / cutoff) for a in "xyz"}
    left = sites.withColumns(cell)
    near = F.array(*[F.struct(*[F.lit(d).alias(n) for d, n in zip((i, j, k), "ijk", strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    right = left.withColumn("d", F.explode(near)).select("structure", (F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy"), (F.col("cz") + F.col("d.k")).alias("cz"), F.col("site").alias("other"), *[F.col(a).alias(f"o{a}") for a in "xyz"])
    square = sum(F.pow(F.col(a) - F.col(f"o{a}"), F.lit(2)) for a in "xyz")
    return left.join(right, ["structure", "cx", "cy", "cz"]).withColumn("square", square).where((F.col("square") > 0) & (F.col("square") <= cutoff * cutoff)).select("structure", "site", "other", "square")


#: Sites of a block, and pairs of a strip: a task holds two blocks and a few numbers for each pair of a strip.
SITES, STRIP = 4096, 1 << 15
_CELL = ["structure", "cx", "cy", "cz"]


def site_blocks(sites: DataFrame, width: float, most: int = SITES) -> DataFrame:
    """block, structure, cx, cy, cz, part, x, y, z, n: the places of a grid cell in parts of about `most`, with the sites at each.

    Sites without a structure or with a coordinate that is missing or not finite touch nothing and are left out. A written table.
    """
    finite = [F.abs(F.col(a)) < float("inf") for a in "xyz"]
    places = sites.where(F.col("structure").isNotNull() & finite[0] & finite[1] & finite[2]).groupBy("structure", "x", "y", "z").agg(F.count("*").alias("n"))
    cells = places.withColumns({f"c{a}": F.floor(F.col(a) / width) for a in "xyz"})
    parts = cells.groupBy(*_CELL).agg(F.ceil(F.count("*") / most).alias("parts"))
    dealt = cells.join(parts, _CELL).withColumn("part", F.pmod(F.xxhash64("x", "y", "z"), "parts"))
    rows = dealt.groupBy(*_CELL, "part").agg(F.collect_list(F.struct("x", "y", "z", "n")).alias("s"))
    return written(rows.select(F.monotonically_increasing_id().alias("block"), *_CELL, "part", *[F.col(f"s.{c}").alias(c) for c in "xyzn"]), "site-blocks")


def block_pairs(blocks: DataFrame) -> DataFrame:
    """a, b, side, structure, x, y, z, n: each pair of blocks in the same or adjoining cells, once, as two rows (a block with itself: one).

    Pairs are named first and dealt out evenly, whatever cells they are of; the rows of a pair come one after the other.
    """
    names = blocks.select(*_CELL, "part", "block")
    half = [d for d in itertools.product((-1, 0, 1), repeat=3) if d >= (0, 0, 0)]
    near = F.explode(F.array(*[F.struct(*[F.lit(i).alias(f"c{a}") for i, a in zip(d, "xyz", strict=True)]) for d in half]))
    right = names.withColumn("d", near).select("structure", *[(F.col(f"c{a}") + F.col(f"d.c{a}")).alias(f"c{a}") for a in "xyz"], F.col("block").alias("b"), F.when((F.col("d.cx") == 0) & (F.col("d.cy") == 0) & (F.col("d.cz") == 0), F.col("part")).alias("own"))
    pairs = names.join(right, _CELL).where(F.col("own").isNull() | (F.col("part") <= F.col("own"))).select(F.col("block").alias("a"), "b")
    ends = F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))
    laid = pairs.select("a", "b", F.posexplode(ends).alias("side", "block")).join(blocks.select("block", "structure", *"xyzn"), "block")
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return laid.select("a", "b", "side", "structure", *"xyzn").repartition(tasks, "a", "b").sortWithinPartitions("a", "b", "side")


def _facing(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """structure, a, b, left, right of each pair of blocks; left and right: places (3, sites) and sites at each, right None for a block with itself."""
    left = None
    for batch in batches:
        for i, (a, b, side, structure) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)):
            cells = [batch.column(k)[i].values.to_numpy() for k in range(4, 8)]
            here = np.stack(cells[:3]), cells[3]
            if a == b:
                yield structure, a, b, here, None
            elif side:
                yield structure, a, b, left, here
            else:
                left = here[0].copy(), here[1].copy()


def _strips(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows of left, gaps (3, rows, right) and their squares for strips of about STRIP pairs."""
    rows = max(1, STRIP // right.shape[1])
    for s in range(0, left.shape[1], rows):
        gap = right[:, None] - left[:, s : s + rows, None]
        square = np.square(gap[0])
        square += np.square(gap[1])
        square += np.square(gap[2])
        yield slice(s, s + rows), gap, square


class Ladder:
    """How many of ascending limits, the first of them 0, are below a number: by a fine table, and by search where a limit falls in the table's step."""

    def __init__(self, limits: np.ndarray, fineness: int = 1 << 14):
        self.limits, self.top = limits, fineness
        self.scale = (fineness - 1) / limits[-1]
        steps = (limits * self.scale).astype(np.int64)
        self.below = np.searchsorted(steps, np.arange(fineness + 1), "left")
        self.split = np.zeros(fineness + 1, dtype=bool)
        self.split[steps] = True

    def rungs(self, x: np.ndarray) -> np.ndarray:
        step = np.minimum(x * self.scale, self.top).astype(np.int64)
        out = self.below[step]
        unsure = np.flatnonzero(self.split[step])
        out[unsure] = np.searchsorted(self.limits, x[unsure], "left")
        return out


def contact_counts(sites: DataFrame, cutoffs: list[float], most: int = SITES) -> DataFrame:
    """structure, cutoff, contacts: ordered pairs of sites (structure, x, y, z) with 0 < distance <= cutoff, where there are any.

    Places in reach are compared block by block within tasks, all cutoffs at once, and only counts leave them. The work is that of
    the pairs of places in adjoining cells of the largest cutoff: linear for structures of a steady density, else quadratic.
    """
    wanted = sorted(set(cutoffs))
    ladder = np.array([0.0, *(c**2 for c in wanted)])
    blocks = site_blocks(sites, wanted[-1] * (1 + 1e-9), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale, found = Ladder(ladder), {}
        for structure, _, _, (x, n), other in _facing(batches):
            y, m = (x, n) if other is None else other
            total, single = np.zeros(len(ladder) + 1, dtype=np.int64), n.max() == m.max() == 1
            for rows, _, square in _strips(x, y):
                rungs = scale.rungs(square.ravel())
                if single:
                    total += np.bincount(rungs, minlength=len(total))
                else:
                    each = np.outer(n[rows], m).ravel()
                    for k in np.flatnonzero(np.bincount(rungs, minlength=len(total))):
                        total[k] += each[rungs == k].sum()
            if structure not in found and len(found) == 1000:
                yield rows_of(found)
                found.clear()
            found[structure] = found.get(structure, 0) + total[1:-1] * (1 if other is None else 2)
        if found:
            yield rows_of(found)

    def rows_of(found: dict) -> pa.RecordBatch:
        counts = np.array([c.cumsum() for c in found.values()])
        names = pa.array(np.repeat(np.arange(len(found)), len(wanted)))
        return pa.RecordBatch.from_arrays([pa.array(list(found), kind).take(names), pa.array(np.tile(wanted, len(found))), pa.array(counts.ravel())], ["structure", "cutoff", "contacts"])

    field = blocks.schema["structure"].dataType
    kind = to_arrow_type(field)
    got = block_pairs(blocks).mapInArrow(run, f"structure {field.simpleString()}, cutoff double, contacts long")
    return got.groupBy("structure", "cutoff").agg(F.sum("contacts").alias("contacts")).where("contacts > 0")


#: Pairs of axes of a site's own block of the Hessian.
AXES = ("xx", "xy", "xz", "yy", "yz", "zz")


def site_hessians(sites: DataFrame, cutoff: float, most: int = SITES) -> DataFrame:
    """structure, site, hxx, hxy, hxz, hyy, hyz, hzz: each site's own block of the network's Hessian; sites without contacts have none.

    Blocks of places meet within tasks, and a task returns one sum for each block of a pair; sites at the same place share theirs.
    """
    blocks = site_blocks(sites, cutoff * (1 + 1e-9), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, a, b, (x, n), other in _facing(batches):
            y, m = (x, n) if other is None else other
            mine, theirs = np.zeros((len(AXES) + 1, len(n))), np.zeros((len(AXES) + 1, len(m)))
            for rows, gap, square in _strips(x, y):
                touch = (square > 0) & (square <= cutoff * cutoff)
                if not touch.any():
                    continue
                weight = touch / np.where(touch, square, 1.0)
                for k, part in enumerate([*(gap["xyz".index(i)] * gap["xyz".index(j)] * weight for i, j in AXES), touch]):
                    mine[k, rows] = part @ m
                    if other is not None:
                        theirs[k] += n[rows] @ part
            for block, total in ((a, mine), (b, theirs)):
                if total[-1].any():
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([0], pa.int32()), pa.array([1]), pa.array([total.tobytes()])], ["block", "slot", "n", "v"])

    def finish(block: int, n: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block]), *(pa.array([row.tolist()]) for row in total.reshape(len(AXES) + 1, -1))], names)

    names = ["block", *(f"h{c}" for c in AXES), "touching"]
    parts = block_pairs(blocks).mapInArrow(run, "block long, slot int, n long, v binary")
    sums = parts.repartition("block").sortWithinPartitions("block").mapInArrow(summed(finish), "block long, " + ", ".join(f"{c} array<double>" for c in names[1:]))
    each = blocks.select("block", "structure", "x", "y", "z").join(sums, "block").select("structure", F.explode(F.arrays_zip("x", "y", "z", *names[1:])).alias("p"))
    known = each.where("p.touching > 0").select("structure", *[F.col(f"p.{c}").alias(c) for c in ("x", "y", "z", *names[1:-1])])
    return sites.join(known, ["structure", "x", "y", "z"]).select("structure", "site", *names[1:-1])
