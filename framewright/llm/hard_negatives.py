"""Operator 13: hard negatives by branch and bound over ball trees.

Rows stay in the tasks that read them: each task sorts its rows by label and builds ball trees of up to
TREE rows, which are written once. Every node knows its centre, radius, labels and smallest id, and its least
upper bound is tightened to integers, since scores are. For a block of queries a tree is walked from the
root, all queries at once. With centre c, radius r and query q, q.c - |q| r and q.c + |q| r bound the scores of
a node's rows; a query leaves a node whose rows all have the wrong label, whose upper bound is under the
query's window or whose lower bound is over it, and whose upper bound is strictly beneath its current kth
score (or equals it while no id there is smaller). What is left at a leaf is compared exactly.

Two searches are made so: the positives of each anchor (its label, no window), then for each anchor and
positive the rows of other labels within the window. Anchors go in blocks of bounded size, broadcast one after
another; a task returns its best k of each query, and only these are shuffled.

Scores are exact: in double precision where no sum can reach 2**53, else in Python's integers; a score beyond
64 bits raises.

Nulls and rows: rows with a null label, vector or id, or with a null or non-finite component, take no part, and
neither do rows whose vector has another length than the anchor's; repeated rows are rows of their own, but none
of the anchor's id is its positive or negative, and repeated anchors are taken once; ties go to the smaller id;
an empty table gives an empty result; further columns are ignored. There are no texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, release, shared_dir, written

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 5, 80, 100
TREE, LEAF = 8192, 64
#: A task builds trees of so many bytes of vectors at a time; bytes of a block of queries, and the most queries.
HELD_BYTES, BLOCK_BYTES, BLOCK_QUERIES = 32 << 20, 16 << 20, 8192
TREES = "dim int, n int, lo long, hi long, body binary"
_EXACT = float(1 << 53)
_LEAST = np.iinfo(np.int64).min


def usable(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v (floor(scale * x) as doubles) of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(~bad)
    # Spark's floor() ends at 64 bits
    down = lambda y: F.rint(y) - F.when(F.rint(y) > y, 1.0).otherwise(0.0)
    v = F.transform("embedding", lambda x: down(x.cast("double") * float(scale)))
    return some.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))


class Tree:
    """A ball tree over rows (n, d) of whole numbers, nodes in the order of a walk."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        self.order = np.arange(len(rows))
        self.rows, self.nodes = rows, []
        if len(rows):
            self._split(0, len(rows))
        self.rows, self.ids, self.labels = rows[self.order], ids[self.order], labels[self.order]
        self._describe()

    def _split(self, lo: int, hi: int) -> int:
        me = len(self.nodes)
        self.nodes.append([lo, hi, -1])
        part = self.rows[self.order[lo:hi]]
        if hi - lo > LEAF:
            far = part[np.argmax(np.square(part - part.mean(axis=0)).sum(axis=1))]
            other = part[np.argmax(np.square(part - far).sum(axis=1))]
            along = part @ (other - far)
            mid = (hi - lo) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(along, mid)]
            self._split(lo, lo + mid)
            self.nodes[me][2] = self._split(lo + mid, hi)
        return me

    def _describe(self) -> None:
        n, d = len(self.nodes), self.rows.shape[1]
        self.at = np.array(self.nodes, dtype=np.int64).reshape(n, 3)
        self.centre, self.radius = np.zeros((n, d)), np.zeros(n)
        self.label, self.least = np.zeros((n, 2), dtype=np.int64), np.zeros(n, dtype=np.int64)
        for i, (lo, hi, _) in enumerate(self.at.tolist()):
            part = self.rows[lo:hi]
            self.centre[i] = part.mean(axis=0)
            self.radius[i] = np.sqrt(np.square(part - self.centre[i]).sum(axis=1).max())
            self.label[i] = self.labels[lo:hi].min(), self.labels[lo:hi].max()
            self.least[i] = self.ids[lo:hi].min()

    def packed(self) -> bytes:
        most = np.abs(self.rows).max(initial=0)
        kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
        head = np.array([len(self.rows), self.rows.shape[1], len(self.at), {"<i2": 0, "<i4": 1, "<f8": 2}[kind]], dtype=np.int64)
        return b"".join(x.tobytes() for x in (head, self.ids, self.labels, self.at, self.label, self.least, self.centre, self.radius, self.rows.astype(kind)))

    @staticmethod
    def unpacked(body: pa.Buffer | bytes) -> "Tree":
        n, d, nodes, kind = np.frombuffer(body, dtype=np.int64, count=4).tolist()
        at, tree = 32, Tree.__new__(Tree)
        for name, shape, dtype in (("ids", (n,), np.int64), ("labels", (n,), np.int64), ("at", (nodes, 3), np.int64), ("label", (nodes, 2), np.int64), ("least", (nodes,), np.int64), ("centre", (nodes, d), np.float64), ("radius", (nodes,), np.float64), ("rows", (n, d), np.dtype(("<i2", "<i4", "<f8")[kind]))):
            size = int(np.prod(shape))
            setattr(tree, name, np.frombuffer(body, dtype=dtype, count=size, offset=at).reshape(shape))
            at += size * np.dtype(dtype).itemsize
        tree.rows = tree.rows.astype(np.float64)
        return tree


class Search:
    """The best k rows of each query so far: score down, id up; queries of one length."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.ids, self.labels, self.q, self.low, self.high, self.same, self.k = ids, labels, vectors, low, high, same, k
        self.norm = np.sqrt(np.square(vectors).sum(axis=1))
        self.most = float(np.abs(vectors).max(initial=0))
        self.score = np.full((len(ids), k), _LEAST, dtype=np.int64)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max, dtype=np.int64)

    def walk(self, tree: Tree) -> None:
        if not len(tree.at):
            return
        exact = self.most * max(1.0, float(np.abs(tree.rows).max(initial=0))) * self.q.shape[1] < _EXACT
        stack = [(0, np.arange(len(self.ids)))]
        while stack:
            node, at = stack.pop()
            at = self._open(tree, node, at)
            if not len(at):
                continue
            lo, hi, right = tree.at[node].tolist()
            if right < 0:
                self._leaf(tree, lo, hi, at, exact)
                continue
            near, far = node + 1, right
            pull = self.q[at].mean(axis=0)
            if pull @ tree.centre[near] < pull @ tree.centre[far]:
                near, far = far, near
            stack += [(far, at), (near, at)]

    def _open(self, tree: Tree, node: int, at: np.ndarray) -> np.ndarray:
        first, last = tree.label[node].tolist()
        mine = self.labels[at]
        at = at[(first <= mine) & (mine <= last)] if self.same else at[(first != last) | (mine != first)]
        if not len(at):
            return at
        middle, reach = self.q[at] @ tree.centre[node], self.norm[at] * tree.radius[node]
        slack = 1e-6 + 1e-9 * (np.abs(middle) + reach + self.norm[at] * np.sqrt(np.square(tree.centre[node]).sum()))
        upper, lower = np.floor(middle + reach + slack), np.ceil(middle - reach - slack)
        kth, last_id = self.score[at, -1], self.found[at, -1]
        better = (upper > kth) | ((upper == kth) & (tree.least[node] < last_id))
        # an open window leaves scores beyond 64 bits to the leaf, which raises
        over, under = (upper >= self.low[at]) | (self.low[at] == _LEAST), (lower <= self.high[at]) | (self.high[at] == -(_LEAST + 1))
        return at[better & over & under]

    def _leaf(self, tree: Tree, lo: int, hi: int, at: np.ndarray, exact: bool) -> None:
        if exact:
            got = (self.q[at] @ tree.rows[lo:hi].T).astype(np.int64)
        else:
            whole = lambda x: np.array([[int(v) for v in r] for r in x.tolist()], dtype=object)
            got = np.array((whole(self.q[at]) @ whole(tree.rows[lo:hi]).T).tolist(), dtype=np.int64)
        ids = np.broadcast_to(tree.ids[lo:hi], got.shape)
        alike = tree.labels[lo:hi][None, :] == self.labels[at][:, None]
        fits = (alike if self.same else ~alike) & (ids != self.ids[at][:, None]) & (got >= self.low[at][:, None]) & (got <= self.high[at][:, None]) & (got >= self.score[at, -1][:, None])
        some = np.flatnonzero(fits.any(axis=1))
        if not len(some):
            return
        at, fits = at[some], fits[some]
        score = np.concatenate([self.score[at], np.where(fits, got[some], _LEAST)], axis=1)
        found = np.concatenate([self.found[at], np.where(fits, ids[some], np.iinfo(np.int64).max)], axis=1)
        # the least 64-bit score marks an empty place, so its negative is not needed
        order = np.lexsort((found, -np.maximum(score, _LEAST + 1)), axis=-1)[:, : self.k]
        self.score[at] = np.take_along_axis(score, order, axis=1)
        self.found[at] = np.take_along_axis(found, order, axis=1)


def trees(rows: DataFrame) -> DataFrame:
    """Rows of TREES: the ball trees of each task's own rows."""

    def built(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ids, labels, v = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((ids, labels))
        for at in range(0, len(order), TREE):
            part = order[at : at + TREE]
            tree = Tree(v[part], ids[part], labels[part])
            cells = (v.shape[1], len(part), int(labels[part].min()), int(labels[part].max()), tree.packed())
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds, strict=True)], ["dim", "n", "lo", "hi", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0
        for b in batches:
            lengths = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths).tolist():
                mine = b.filter(pa.array(lengths == dim))
                v = mine.column(2).flatten().to_numpy(zero_copy_only=False).reshape(mine.num_rows, dim)
                held.setdefault(dim, []).append((mine.column(0).to_numpy(), mine.column(1).to_numpy(), v))
                size += v.nbytes + 64 * mine.num_rows
            if size >= HELD_BYTES:
                for dim in list(held):
                    yield from built(held.pop(dim))
                size = 0
        for dim in list(held):
            yield from built(held.pop(dim))
        release()

    return rows.mapInArrow(run, TREES)


def _searched(forest: DataFrame, queries: pa.Table, same: bool, k: int) -> DataFrame:
    """q, w, best (array of minus score and id): each task's best k rows of each query and window.

    queries: q, vec_id, label, v, w, low, high.
    """
    lengths = queries.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    packed = {}
    for dim in np.unique(lengths).tolist():
        mine = queries.filter(pa.array(lengths == dim)).combine_chunks()
        column = lambda c, m=mine: m.column(c).to_numpy()
        v = mine.column("v").combine_chunks().flatten().to_numpy().reshape(mine.num_rows, dim)
        packed[dim] = (*map(column, ("q", "w", "vec_id", "label")), v, column("low"), column("high"))
    sent = forest.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches: dict[int, Search] = {}
        for b in batches:
            for dim, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if dim in sent.value:
                    if dim not in searches:
                        searches[dim] = Search(*sent.value[dim][2:], same, k)
                    searches[dim].walk(Tree.unpacked(body.as_buffer()))
        for dim, got in searches.items():
            q, w = sent.value[dim][:2]
            full = got.score > _LEAST
            some = np.flatnonzero(full.any(axis=1))
            for at in range(0, len(some), 4096):
                part = some[at : at + 4096]
                n = full[part].sum(axis=1)
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(-got.score[part][full[part]]), pa.array(got.found[part][full[part]])], ["s", "id"])
                yield pa.RecordBatch.from_arrays([pa.array(q[part]), pa.array(w[part]), pa.ListArray.from_arrays(pa.array(offsets), pairs)], ["q", "w", "best"])
        release()

    found = forest.select("dim", "body").mapInArrow(run, "q long, w int, best array<struct<s:bigint,id:bigint>>")
    return found.groupBy("q", "w").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))


def mined(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK_QUERIES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for all anchors among rows (vec_id, label, v).

    A negative's score is at least low and at most high hundredths of the positive's.
    """
    spark, work = rows.sparkSession, []
    forest = written(trees(rows), "ball-trees", work)
    anchors = rows.where(anchor).distinct()
    total, widest = anchors.agg(F.count("*"), F.max(F.size("v"))).first()
    block = max(1, min(block, BLOCK_BYTES // (8 * max(1, widest or 1))))
    blocks = max(1, -(-total // block))
    base = f"{shared_dir(spark)}/framewright-anchors-{uuid.uuid4().hex}"
    work.append(base)
    # a column of the path: each block is read without the others
    anchors.withColumn("q", F.monotonically_increasing_id()).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).write.partitionBy("block").parquet(base)
    kind = "vec_id long, label long, v array<double>, q long, block long"
    out, results = f"{shared_dir(spark)}/framewright-hard-negatives-{uuid.uuid4().hex}", []
    for i in range(blocks):
        mine = spark.read.schema(kind).parquet(base).where(F.col("block") == i).select("q", "vec_id", "label", "v")
        whole = mine.select("*", F.lit(0).alias("w"), F.lit(_LEAST).alias("low"), F.lit(-(_LEAST + 1)).alias("high")).toArrow()
        if not whole.num_rows:
            continue
        first = written(_searched(forest, whole, True, positives), "positives", work)
        each = first.select("q", F.posexplode("best").alias("w", "p")).select("q", F.col("w").cast("int").alias("w"), F.col("p.id").alias("positive_id"), (-F.col("p.s")).alias("positive_score"))
        # whole numbers s with low * p <= 100 * s <= high * p
        wide = F.col("positive_score").cast("decimal(20,0)")
        bounds = (F.ceil(wide * low / 100).cast("long").alias("low"), F.floor(wide * high / 100).cast("long").alias("high"))
        windows = mine.join(each, "q").select("q", "vec_id", "label", "v", "w", *bounds).where("low <= high").toArrow()
        if windows.num_rows:
            best = _searched(forest, windows, False, negatives)
            got = best.select("q", "w", F.posexplode("best").alias("rank", "x")).join(each, ["q", "w"]).join(mine.select("q", F.col("vec_id").alias("anchor_id")), "q")
            got = got.select("anchor_id", "positive_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("negative_id"), "positive_score", (-F.col("x.s")).alias("negative_score"))
            got.write.parquet(f"{out}/block={i}")
            results.append(i)
    discard(spark, work)
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.read.schema(result).parquet(*[f"{out}/block={i}" for i in results]) if results else spark.createDataFrame([], result)


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """The mined rows of a table (vec_id, embedding, label): every hundredth id is an anchor, every seventh label is shifted first."""
    rows = usable(embeddings)
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mined(rows, F.col("vec_id") % 100 == 0)


#: DuckDB SQL with the rows of `hard_negatives`.
ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id, e.label = a.label AS same, list_inner_product(a.v, e.v)::BIGINT AS score FROM e, (SELECT DISTINCT * FROM e WHERE vec_id % 100 = 0) a WHERE a.vec_id <> e.vec_id AND len(a.v) = len(e.v)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""
