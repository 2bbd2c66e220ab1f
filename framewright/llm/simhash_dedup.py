"""Operator 3: SimHash near-duplicate classes by meet-in-the-middle ball hashing.

A fingerprint is the bitwise majority of the XXH64 values of a text's word shingles.
Two fingerprints link at `radius` 3 or fewer differing bits. Half of the radius is one
bit, so every distinct fingerprint emits its ball of one-bit variants; as the radius is
odd, the third bit is covered by blanking one of three blocks first: of up to three
differing bits at least one lies in some block, and outside it at most two are left,
which two one-bit balls meet over. That makes 130 variants instead of the 2,081 + 65 of a
whole-word ball, and about five chance collisions for each fingerprint at 3e10 of them.

Variants are shuffled, colliding fingerprints are verified by their exact distance, and
links join to classes by distributed star contraction. `deduplicated` also links texts of
which 80 % of the 5-word shingles agree (see "similarity links" below). Copies share one fingerprint and
are never expanded into pairs; within a large bucket a linear scheme takes the place of
all pairs (see `_links`).

Nulls and rows: a null text counts as empty (fingerprint zero, linked like any other); a
null id is returned with its fingerprint and never names a class while the class has an
id; repeated rows are each returned; texts of any length are hashed whole, in blocks; a bit that just half of
the shingles set is 0; of equal candidates for a centre or a class's name the smallest number wins; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Numbered, WordHasher, components, discard, free_name, mix, partitions_for, slices, written
from .decontaminate import shingles

RADIUS = 3
#: Blocks of bits that are blanked in turn: (first bit, bits).
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Buckets up to this size compare all pairs.
SMALL = 16
_COUNT_ROWS = 1 << 16
#: Fingerprints whose variants are dealt out at once.
_CHUNK = 1 << 14
MAX_TASKS = 50_000
_words = WordHasher(SPACES)


def fingerprint(text: str | None, n: int = 3) -> int:
    """The unsigned 64-bit SimHash of one text's n-word shingles."""
    seen, ones, carry = 0, np.zeros(64, dtype=np.int64), []
    for block in _words.cut((text or "").encode().lower()):
        words = carry + block.split()
        if len(words) >= n:
            ones += _bit_counts(words, n)
            seen += len(words) - n + 1
        carry = words[max(0, len(words) - n + 1) :]
    if not seen and carry:
        ones, seen = _bit_counts(carry, len(carry)), 1
    return int.from_bytes(np.packbits(2 * ones > seen).tobytes(), "big")


def _bit_counts(words: list[bytes], n: int) -> np.ndarray:
    """How often each bit is set among the hashes of the words' n-word shingles."""
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = len(words) - n + 1
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[s:e], 42) for s, e in zip(starts[:k].tolist(), ends[n - 1 :].tolist(), strict=True)])
    rows = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8)
    return sum(np.unpackbits(rows[at : at + _COUNT_ROWS], axis=1).sum(axis=0, dtype=np.int64) for at in range(0, k, _COUNT_ROWS))


def fingerprints(docs: DataFrame, text: str = "text", n: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and fp (signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), n) for t in b.column(len(keep))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(fp)], [*keep, "fp"])

    src = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInArrow(run, f"{kinds}, fp long")


#: The ball of half the radius around a fingerprint for each blanked block, as 130 variants: bits kept,
#: bit flipped, block. A variant's key bears the block's number in the blanked bits.
_VARIANTS = [(first, sum(1 << i for i in range(64) if not first <= i < first + n), [0, *(1 << i for i in range(64) if not first <= i < first + n)]) for first, n in BLOCKS]
_KEPT = np.array([kept for _, kept, flips in _VARIANTS for _ in flips], dtype=np.uint64)
_FLIP = np.array([flip | g << first for g, (first, _, flips) in enumerate(_VARIANTS) for flip in flips], dtype=np.uint64)
_PACKED = np.dtype([("fp", "<u8"), ("variant", "u1")])


def variant_keys(fp: np.ndarray, variant: np.ndarray) -> np.ndarray:
    return (fp & _KEPT[variant]) ^ _FLIP[variant]


def variants(fps: DataFrame, parts: int) -> DataFrame:
    """(part, packed): all variants of all fingerprints, those of one key in one of `parts` parts.

    Variants travel as nine bytes, the fingerprint and the variant's number, in one value for each part and
    some thousand fingerprints; keys are worked out anew where they arrive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(len(_KEPT), dtype=np.uint8)
        for b in batches:
            every = b.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(every), _CHUNK):
                fp = np.repeat(every[at : at + _CHUNK], len(number))
                variant = np.tile(number, len(fp) // len(number))
                part = (mix(variant_keys(fp, variant)) % np.uint64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                part, packed = part[order], np.empty(len(fp), dtype=_PACKED)
                packed["fp"], packed["variant"] = fp[order], variant[order]
                first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                offsets = np.append(first, len(part)).astype(np.int32) * _PACKED.itemsize
                values = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
                yield pa.RecordBatch.from_arrays([pa.array(part[first]), values], ["part", "packed"])

    return fps.select("fp").mapInArrow(run, "part int, packed binary")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


_ONE = np.concatenate([[0], [1 << i for i in range(64)]]).astype(np.uint64)
#: Any three bits hold two of one half, so two flips within a half suffice.
_TWO = np.array([(1 << i) | (1 << j) for lo in (0, 32) for i in range(lo, lo + 32) for j in range(i + 1, lo + 32)], dtype=np.uint64)


def _links(bucket: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join a bucket's fingerprints exactly as all pairs within the radius would, in linear space.

    For a midpoint m let A be the fingerprints within one bit of it and B those at two
    bits. Any member of A is within three bits of all of A and B, so a star around one of
    them has only true links; every pair within three bits has such a midpoint.
    """
    n = len(bucket)
    point = (bucket[:, None] ^ _ONE[None, :]).ravel()
    owner = np.repeat(np.arange(n), len(_ONE))
    order = np.argsort(point, kind="stable")
    point, owner = point[order], owner[order]
    first = np.concatenate([[True], point[1:] != point[:-1]])
    head = owner[np.flatnonzero(first)[np.cumsum(first) - 1]]
    off = head != owner
    yield bucket[head[off]], bucket[owner[off]]
    point, head = point[first], head[first]
    for at in range(0, n, 512):
        part = bucket[at : at + 512]
        far = (part[:, None] ^ _TWO[None, :]).ravel()
        found = np.minimum(np.searchsorted(point, far), len(point) - 1)
        hit = np.flatnonzero(point[found] == far)
        a, b = bucket[head[found[hit]]], part[hit // len(_TWO)]
        yield a[a != b], b[a != b]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of packed variants that come sorted by part."""
    held, of = [], None
    for b in batches:
        for part, packed in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if part != of and held:
                yield from _part_links(held)
                held = []
            of = part
            held.append(packed.as_py())
    if held:
        yield from _part_links(held)


def _part_links(held: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Links of one part's variants: sort by key, compare within each run."""
    got = np.frombuffer(b"".join(held), dtype=_PACKED)
    fp, key = got["fp"].copy(), variant_keys(got["fp"], got["variant"])
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([at, [len(fp)]]))
    left, right = [], []
    for d in range(1, SMALL):
        runs = (size > d) & (size <= SMALL)
        if not runs.any():
            break
        count = size[runs] - d
        i = np.repeat(at[runs] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        a, b = fp[i], fp[i + d]
        near = distance(a, b) <= RADIUS
        left.append(a[near])
        right.append(b[near])
    for s, n in zip(at[size > SMALL], size[size > SMALL], strict=True):
        for a, b in _links(fp[s : s + n]):
            pair = np.unique(np.stack([a, b]), axis=1)
            left.append(pair[0])
            right.append(pair[1])
    if left:
        pair = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
        pair = pair[:, pair[0] != pair[1]].view(np.int64)
        for i in range(0, pair.shape[1], 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(pair[0, i : i + (1 << 18)]), pa.array(pair[1, i : i + (1 << 18)])], ["a", "b"])


def linked(fps: DataFrame) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints `fps` (fp: long) as all pairs within the radius do.

    A part holds about 1.5 million variants whatever the table's size; beyond MAX_TASKS parts a task takes
    several, one after another.
    """
    parts = partitions_for(fps.sparkSession, fps.count() * len(_KEPT), 1_500_000)
    dealt = variants(fps, parts).repartitionById(min(parts, MAX_TASKS), F.col("part") % MAX_TASKS).sortWithinPartitions("part")
    return dealt.mapInArrow(_verify, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest id reachable) of every row."""
    work: list[str] = []
    got = written(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", n), "fingerprints")
    fps = written(got.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints", work)
    roots = components(linked(fps.select("fp")), "links", work)
    named = written(roots.join(fps.hint("merge"), roots.node == fps.fp).select("fp", "root", "first_id"), "roots", work)
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(least.hint("merge"), "root").select("fp", "component_id")
    classes = fps.join(named.hint("merge"), "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    classes = written(classes, "classes")
    discard(docs.sparkSession, work)
    return got.join(classes.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- similarity links ----------------------------------------------------------------------------
#
# Copies with a few edited words differ in up to a dozen bits, too many for ball hashing (half of
# twelve would be 83 million variants). Their samples often agree to the bit, though: a sample is
# the SAMPLE smallest of the text's distinct five-word shingles under one of SAMPLES orders, and
# its fingerprint the same bitwise majority. Texts of similarity J agree on a sample with a chance
# of about J**4, so at 0.8 none of 24 agrees in about 3 of a million cases. Texts that agree are verified by
# the exact similarity of their shingle sets: first all of a bucket against one centre, which
# settles most buckets in linear space, then, where texts of a bucket are in different classes
# still, all pairs across classes, in tiles of bounded size.

SHINGLE = 5
SIMILARITY = 0.8
SAMPLES, SAMPLE = 24, 4
#: A tile of a bucket holds about so many texts and shingles; two tiles meet in one task.
TILE_TEXTS, TILE_SHINGLES = 1024, 500_000
_ORDERS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The distinct hashes of each text's 5-word shingles (fewer words: the whole sequence)."""
    for _, h in _words.texts([(t or "").encode().lower() for t in texts]):
        yield np.unique(shingles(h, min(SHINGLE, len(h)))) if len(h) else h


def sample_fingerprints(found: np.ndarray) -> np.ndarray:
    """SimHash of each sample of a shingle set."""
    least = np.full((SAMPLES, 0), 0, dtype=np.uint64)
    for at in range(0, len(found), 1 << 15):
        least = np.concatenate([least, mix(found[None, at : at + (1 << 15)] ^ _ORDERS[:, None])], axis=1)
        if least.shape[1] > SAMPLE:
            least = np.partition(least, SAMPLE - 1, axis=1)[:, :SAMPLE]
    bits = np.unpackbits(np.ascontiguousarray(least).view(np.uint8).reshape(SAMPLES, -1, 8), axis=2)
    return np.packbits(2 * bits.sum(axis=1, dtype=np.int64) > least.shape[1], axis=1).view(np.int64).ravel()


def _sampled(docs: DataFrame) -> DataFrame:
    """row, doc_id, the text's hashes `key` and `other`, fp, sample fingerprints and number of different shingles of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, texts in slices(b.column(4)):
                fp = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
                rows, sizes = zip(*[((sample_fingerprints(f) ^ _ORDERS.view(np.int64)).tolist() if len(f) else None, len(f)) for f in shingle_sets(texts)], strict=True)
                part = b.slice(s, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(fp), pa.array(rows, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], ["row", "doc_id", "key", "other", "fp", "samples", "size"])

    src = docs.select("row", "doc_id", F.xxhash64("text").alias("key"), F.xxhash64(F.lit(1), "text").alias("other"), "text")
    return src.mapInArrow(run, "row long, doc_id long, key long, other long, fp long, samples array<long>, size long")


def _sets(texts: DataFrame) -> DataFrame:
    """node and shingle set of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, part in slices(b.column(1)):
                rows = [f.view(np.int64).tolist() for f in shingle_sets(part)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, len(part)), pa.array(rows, pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def tile_links(part: pa.Table) -> pa.Table:
    """(a, b): links of one cell's texts (node, root, shingles) that join them as all similar pairs across roots do."""
    node, root = part["node"].to_numpy(), part["root"].to_numpy()
    sets = part["shingles"].combine_chunks()
    size = np.diff(sets.offsets.to_numpy())
    owner = np.repeat(np.arange(len(node)), size)
    value, at, held = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
    column = np.cumsum(held > 1) - 1  # a shingle of one text is shared with none
    shared = held[at] > 1
    owner, column = owner[shared], column[at[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(node), len(node)), dtype=np.float32)
    for first in range(0, int(np.count_nonzero(held > 1)), 4096):
        s, e = np.searchsorted(column, [first, first + 4096])
        block = np.zeros((len(node), 4096), dtype=np.float32)
        block[owner[s:e], column[s:e] - first] = 1
        both += block @ block.T
    near = (both / (size[:, None] + size[None, :] - both.astype(np.float64)) >= SIMILARITY) & (root[:, None] != root[None, :])
    left, right, new = [node[:0]], [node[:0]], np.ones(len(node), dtype=bool)
    for i in range(len(node)):
        front = np.array([i])
        new[i] = False
        while len(front):
            found = np.flatnonzero(near[front].any(axis=0) & new)
            left.append(node[front[near[np.ix_(front, found)].argmax(axis=0)]])
            right.append(node[found])
            new[found] = False
            front = found
    return pa.table({"a": np.concatenate(left), "b": np.concatenate(right)})


def open_cells(rows: DataFrame, centre: DataFrame, roots: DataFrame, work: list[str]) -> DataFrame:
    """(c, node, root): cells in which all pairs meet that no centre has settled.

    A bucket is open while its texts, without the centre, are of several classes. Pairs within a class
    need no comparison, so its largest class (B) meets the rest (O) only: each cell holds one tile of O
    and one of B, or two of O. Buckets of the same texts count once.
    """
    members = rows.join(centre.where("n > 2").select("s", "centre").hint("merge"), "s").where("node <> centre").join(roots.select("node", "root").hint("merge"), "node", "left")
    members = written(members.select("s", "node", "size", F.coalesce("root", "node").alias("root")), "bucket-texts", work)
    classes = members.groupBy("s", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark"))
    buckets = classes.groupBy("s").agg(F.count("*").alias("classes"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.sum("mark").alias("mark"), F.max(F.struct("n", "root", "size")).alias("big")).where("classes > 1")
    once = buckets.groupBy("n", "size", "mark").agg(F.min(F.struct("s", "big")).alias("x")).select("x.s", F.col("x.big.root").alias("big"), "n", "size", F.col("x.big.n").alias("n_b"), F.col("x.big.size").alias("size_b"))
    tiles = lambda n, size: F.greatest(F.ceil(n / TILE_TEXTS), F.ceil(size / TILE_SHINGLES)).cast("int")
    once = once.select("s", "big", tiles(F.col("n") - F.col("n_b"), F.col("size") - F.col("size_b")).alias("t_o"), tiles(F.col("n_b"), F.col("size_b")).alias("t_b"))
    inside = members.join(once.hint("merge"), "s").withColumn("in_b", F.col("root") == F.col("big"))
    mine = F.pmod(F.xxhash64("node", F.lit(1)), F.when(F.col("in_b"), F.col("t_b")).otherwise(F.col("t_o"))).cast("int")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    p = F.col("p")
    cell = lambda own, o, other: F.struct(F.lit(own).alias("own"), o.alias("o"), other.alias("other"))
    of_b = F.transform(each("t_o"), lambda q: cell(0, q, p))
    of_o = F.concat(F.transform(each("t_b"), lambda q: cell(0, p, q)), F.transform(F.filter(each("t_o"), lambda q: q != p), lambda q: cell(1, F.least(p, q), F.greatest(p, q))))
    return inside.withColumn("p", mine).select("s", "node", "root", F.explode(F.when(F.col("in_b"), of_b).otherwise(of_o)).alias("c")).select(F.struct("s", "c").alias("c"), "node", "root")


def similarity_classes(base: Numbered, texts: DataFrame, edges: DataFrame, text: str, work: list[str]) -> DataFrame:
    """(node, root): classes of texts by `edges` and by a similarity of SIMILARITY or more of their 5-word shingle sets.

    In each bucket of one sample fingerprint every text is compared with one centre, another for each
    sample; then all pairs of a bucket that are in different classes (see `open_cells`).
    """
    rows = texts.where("samples is not null").select("node", "size", F.explode(F.array_distinct("samples")).alias("s"))
    centre = rows.groupBy("s").agg(F.min_by("node", F.xxhash64("node", "s")).alias("centre"), F.count("*").alias("n")).where("n > 1")
    centre = written(centre, "centres", work)
    pairs = rows.select("s", "node").join(centre.hint("merge"), "s").where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    pairs = written(pairs.distinct(), "candidates", work)
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    held = base.joined(wanted.select(F.col("node").alias(base.row), F.lit(True).alias("wanted")), "wanted").where("wanted")
    sets = written(_sets(held.select(F.col(base.row).alias("node"), F.col(text).cast("string").alias("text"))), "shingle-sets", work)
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"of_{c}")).hint("merge")
    both = F.size(F.array_intersect("of_a", "of_b"))
    share = both / (F.size("of_a") + F.size("of_b") - both)
    stars = pairs.join(side("a"), "a").join(side("b"), "b").where(share >= SIMILARITY).select("a", "b")
    roots = written(components(edges.union(stars), "classes", work), "roots", work)
    cells = written(open_cells(rows, centre, roots, work), "cells", work)
    if cells.isEmpty():
        return roots
    dealt = cells.join(sets.hint("merge"), "node").select("c", "node", "root", "shingles")
    rest = written(dealt.groupBy("c").applyInArrow(tile_links, "a long, b long").distinct(), "links-in-tiles", work)
    return roots if rest.isEmpty() else written(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(rest), "all-classes", work), "all-roots", work)


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The row with the smallest id of each class, all columns; rows without an id stay.

    A class joins texts that are equal, whose fingerprints are within the radius, or whose 5-word
    shingle sets are similar. Of rows of one id and class the earliest stays. The rows are written once,
    numbered, and stay where they are: everything is decided on numbers, hashes and shingle sets.
    """
    spark, work = docs.sparkSession, []
    base = Numbered(docs, "rows")
    src = base.df.select(F.col(base.row).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keyed = written(_sampled(src), "sampled", work)
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row"))).alias("first")
    nodes = keyed.groupBy("key", "other").agg(F.min("row").alias("node"), first, F.any_value("fp").alias("fp"), F.any_value("samples").alias("samples"), F.any_value("size").alias("size"))
    nodes = written(nodes, "texts", work)
    by_fp = written(nodes.groupBy("fp").agg(F.min("node").alias("k")), "fingerprints", work)
    near = linked(by_fp.select("fp"))
    at = lambda c: by_fp.select(F.col("fp").alias(c), F.col("k").alias(f"k{c}")).hint("merge")
    edges = near.join(at("a"), "a").join(at("b"), "b").select(F.col("ka").alias("a"), F.col("kb").alias("b"))
    edges = edges.union(nodes.select("node", "fp").join(by_fp.hint("merge"), "fp").where("node <> k").select(F.col("node").alias("a"), F.col("k").alias("b")))
    roots = similarity_classes(base, nodes, edges, text, work)
    named = nodes.select("key", "other", "node", "first").join(roots.hint("merge"), "node", "left").select("key", "other", "first", F.coalesce("root", "node").alias("root"))
    named = written(named, "class-of-text", work)
    # A table of its own, so that adaptive execution can split the rows of a large class in the join.
    least = written(named.groupBy("root").agg(F.min("first").alias("kept")).select("root", F.col("kept.row").alias("kept")), "kept", work)
    kept = named.join(least.hint("merge"), "root").select("key", "other", "kept")
    later = keyed.where("doc_id is not null").select("row", "key", "other").join(kept.hint("merge"), ["key", "other"]).where("row <> kept")
    later = written(later.select(F.col("row").alias(base.row), F.lit(True).alias("_later")), "later-copies")
    discard(spark, work)
    flag = free_name(base.df, "_later")
    return base.joined(later.withColumnRenamed("_later", flag), flag).where(F.col(flag).isNull()).select(*docs.columns)
