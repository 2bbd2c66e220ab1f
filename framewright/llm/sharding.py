"""Operator 12: shards by a hierarchical weighted hash tree, in DataFrame operations only.

A topology is a list of leaves (region, rack, shard, weight); a rack weighs what its shards weigh and a
region what its racks weigh. A row descends from the root: at each level every child draws -ln(u) / weight,
where u is a uniform number from the MD5 of the row's key and the child's path, and the least draw wins, so
a child is met in proportion to its weight. A draw depends on the key, the child and its weight alone.
Hence a child that grows only wins rows, one that shrinks only loses rows, and all movement has an end in
a subtree whose weight changes; a shard added in a region of its own takes rows into itself and moves no
others. `topology` adds shards so, which makes the law `key` hold for every count from `base` on.

Places within a shard come from a table of numbers (no texts), dealt out by ranges of (shard, key) that are
as long for hot keys and repeated rows as for others (a row's number is the last part of its order).

Nulls and rows: a null text counts as empty (8 bytes, checksum zero); null keys are one key and share a
shard; repeated rows and equal texts of different keys are each placed, by key alone, so equal texts may lie
in different shards; texts of any length are only measured and hashed; ties of draws go to the child named
first; an empty table gives an empty result; `assigned` keeps further columns under any names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, in_order, written
from .pii import let

Leaf = tuple[str, str, int, float]
#: Size of a row beside its text's bytes, fixed by the contract.
OVERHEAD = 8
_TREE = "array<struct<name:string,w:double,at:array<struct<name:string,w:double,at:array<struct<name:string,w:double,shard:int>>>>>>"


def topology(shards: int, base: int = 24, racks: int = 3, each: int = 4) -> list[Leaf]:
    """`base` shards of weight 1 in regions of `racks` racks of `each` shards, and every later shard in a region of its own."""
    if shards < base:
        raise ValueError(f"a topology that starts with {base} shards has no form with {shards}")
    full = [(f"r{i // (racks * each)}", f"k{i // each % racks}", i, 1.0) for i in range(base)]
    return full + [(f"x{i}", "k0", i, 1.0) for i in range(base, shards)]


def tree(leaves: list[Leaf]) -> Column:
    """The topology as a constant nested array; weights of inner nodes are sums, children of no weight are left out."""
    regions: dict[str, dict[str, list[tuple[int, float]]]] = {}
    for region, rack, shard, weight in leaves:
        if weight < 0:
            raise ValueError(f"shard {shard} has a negative weight")
        if weight > 0:
            regions.setdefault(region, {}).setdefault(rack, []).append((shard, weight))
    if not regions:
        raise ValueError("no shard has a weight")
    total = lambda shards: float(sum(w for _, w in shards))
    shards_of = lambda r, k, shards: [{"name": f"{r}/{k}/{s}", "w": float(w), "shard": s} for s, w in shards]
    racks_of = lambda r, racks: [{"name": f"{r}/{k}", "w": total(s), "at": shards_of(r, k, s)} for k, s in racks.items()]
    rows = [{"name": r, "w": sum(map(total, racks.values())), "at": racks_of(r, racks)} for r, racks in regions.items()]
    return F.from_json(F.lit(json.dumps(rows)), _TREE)


def uniform(key: Column, name: Column) -> Column:
    """A number in (0, 1) of the first 52 bits of an MD5."""
    return (F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), name)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _won(children: Column, key: Column) -> Column:
    draws = F.transform(children, lambda c, i: F.struct((-F.log(uniform(key, c["name"])) / c["w"]).alias("draw"), i.alias("i")))
    return F.get(children, F.array_min(draws)["i"])


def shard_of(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a key: the region, then its rack, then its shard with the least draw."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    return let(_won(tree(leaves), key), lambda region: let(_won(region["at"], key), lambda rack: _won(rack["at"], key)["shard"]))


def assigned(docs: DataFrame, leaves: list[Leaf], key: str = "doc_id", out: str = "shard") -> DataFrame:
    """docs with the shard of each row; nothing is shuffled."""
    return docs.withColumn(out, shard_of(F.col(key), leaves))


def write_shards(docs: DataFrame, path: str, leaves: list[Leaf], key: str = "doc_id") -> None:
    """Writes docs as Parquet, a folder `shard=<n>` for each shard; a large shard becomes several files."""
    shard = free_name(docs, "shard")
    assigned(docs, leaves, key, shard).hint("rebalance", shard).write.partitionBy(shard).parquet(path)


def placed(docs: DataFrame, before: list[Leaf], after: list[Leaf], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard and slot under `before`, grown_shard under `after`."""
    work: list[str] = []
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key), (F.octet_length(body).cast("bigint") + OVERHEAD).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), shard_of(F.col(key), before).alias("shard"), shard_of(F.col(key), after).alias("grown_shard"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "shard-rows", work)
    got = in_order(rows, ["shard"], [F.col(c) for c in (key, "size", "text_crc32", "row")], "slot", "shard-slots")
    discard(docs.sparkSession, work)
    return got.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def oracle(before: list[Leaf], after: list[Leaf]) -> str:
    """DuckDB SQL with the rows of `placed`."""
    bits = "(SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce([i] || range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)))"
    parts = [f"tbl AS (SELECT {bits} AS t)", "d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id::VARCHAR, '') AS k, coalesce(text, '') AS text FROM documents)"]
    for name, leaves in (("a", before), ("b", after)):
        values = ", ".join(f"({i}, '{r}', '{k}', {s}, {w})" for i, (r, k, s, w) in enumerate(leaves))
        parts.append(f"leaf_{name}(i, region, rack, shard, w) AS (VALUES {values})")
        draw = lambda of, path: f"-ln((('0x' || substr(md5(k || '/' || {path}), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0) / {of}"
        parts.append(f"reg_{name} AS (SELECT rid, k, region FROM d, (SELECT region, sum(w) AS w, min(i) AS i FROM leaf_{name} GROUP BY 1) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY {draw('w', 'region')}, i) = 1)")
        parts.append(f"rack_{name} AS (SELECT rid, k, region, rack FROM reg_{name} JOIN (SELECT region, rack, sum(w) AS w, min(i) AS i FROM leaf_{name} GROUP BY 1, 2) USING (region) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY {draw('w', "region || '/' || rack")}, i) = 1)")
        parts.append(f"shard_{name} AS (SELECT rid, shard FROM rack_{name} JOIN leaf_{name} USING (region, rack) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY {draw('w', "region || '/' || rack || '/' || shard")}, i) = 1)")
    crc = "list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))"
    parts.append(f"e AS (SELECT d.rid, doc_id, strlen(text)::BIGINT + {OVERHEAD} AS size, xor({crc}, 4294967295::BIGINT) AS text_crc32, a.shard, b.shard AS grown_shard FROM d JOIN shard_a a USING (rid) JOIN shard_b b USING (rid), tbl)")
    return f"WITH {', '.join(parts)} SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard FROM e"
