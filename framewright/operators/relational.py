"""Keyed matching, counting and rollups over atom, check and task tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from framewright.functions.scalars import is_heavy


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows of each key the one with the smallest `order` (combined before the shuffle)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def contract_keys(reference_atoms: DataFrame, indices: DataFrame) -> DataFrame:
    """k, resid, atom_name, x, y, z of the contract's atoms; k is their order."""
    listed = indices.select(F.posexplode("atom_indices").alias("k", "ordinal"))
    return listed.join(reference_atoms, "ordinal").select("k", "resid", "atom_name", "x", "y", "z")


def resolve_contract(contract: DataFrame, topology: DataFrame) -> DataFrame:
    """contract with the submitted ordinal of each atom (null: missing), by residue and atom name, first atom wins, whatever the chain."""
    own = keep_first(topology.select("resid", "atom_name", "ordinal"), ["resid", "atom_name"], "ordinal")
    return contract.join(own, ["resid", "atom_name"], "left").select(*contract.columns, F.col("ordinal").alias("own_ordinal"))


def missing_contract(contract: DataFrame, topology: DataFrame) -> DataFrame:
    return contract.join(topology, ["resid", "atom_name"], "left_anti")


def composition(atoms: DataFrame, *keys: str) -> DataFrame:
    """heavy, atoms, residues, chains: one row, or one of each key."""
    return atoms.groupBy(*keys).agg(F.count_if(is_heavy(F.col("element"))).alias("heavy"), F.count("*").alias("atoms"), F.count_distinct("chain", "resid").alias("residues"), F.count_distinct("chain").alias("chains"))


def heavy_by_residue(atoms: DataFrame) -> DataFrame:
    return atoms.where(is_heavy(F.col("element"))).groupBy("chain", "resid").agg(F.count("*").alias("heavy"))


def incomplete_residues(atoms: DataFrame, expected: DataFrame, want: Column) -> DataFrame:
    """Expected residues (key chain:resid) whose heavy atoms are not exactly `want`, with their count."""
    counts = heavy_by_residue(atoms).select(F.concat_ws(":", "chain", "resid").alias("key"), "heavy")
    return unlike(expected, counts, "key", "heavy", want)


def unlike(expected: DataFrame, counts: DataFrame, key: str, count: str, want: Column) -> DataFrame:
    """Expected keys whose count (0 where there is none) is not `want`."""
    return expected.join(counts, key, "left").select(key, F.coalesce(count, F.lit(0)).alias(count)).where(F.col(count) != want)


def net_charge(particles: DataFrame, charge: Column, limit: float, *keys: str) -> DataFrame:
    """charge and neutral (below `limit` on either side) of all particles, or of those of each key."""
    return particles.groupBy(*keys).agg(F.sum(charge).alias("charge")).withColumn("neutral", F.abs("charge") < limit)


def first_of(df: DataFrame, keys: list[str], order: list[Column], k: int, skip: int = 0) -> DataFrame:
    """Rows `skip` to `skip` + k of each key in an order, with their `rank`; ranks are cut off before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("rank", rank).where(F.col("rank") < skip + k).where(F.col("rank") >= skip)


def broken_pairs(atoms: DataFrame, pairs: DataFrame, limit: Column, atom_name: str = "SG") -> DataFrame:
    """pairs (a, b: residue ids) that are missing or further apart than limit; of atoms with one residue id the last counts."""
    last = keep_last(atoms.where(F.col("atom_name") == atom_name).select("resid", "x", "y", "z", "ordinal"), ["resid"], "ordinal")
    at = lambda side: last.select(F.col("resid").alias(side), F.struct("x", "y", "z").alias(f"at_{side}"))
    both = pairs.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).join(at("a"), "a", "left").join(at("b"), "b", "left")
    gap = F.sqrt(sum(F.pow(F.col(f"at_a.{c}") - F.col(f"at_b.{c}"), F.lit(2)) for c in "xyz"))
    return both.select("a", "b", gap.alias("distance")).where(F.col("distance").isNull() | (F.col("distance") > limit))


def with_category(results: DataFrame, categories: DataFrame, default: str = "prep") -> DataFrame:
    """results with each check's category; checks that the contract doesn't list take the default."""
    return results.join(categories.select("check_id", F.col("category").alias("_c")), "check_id", "left").withColumn("category", F.coalesce("_c", F.lit(default))).drop("_c")


def category_rollup(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """passed and total by category, and over all (category null), unweighted; `weight`, if there, is summed beside."""
    keys = keys or []
    weighted = [F.sum("weight").alias("weight"), F.sum(F.when(F.col("passed"), F.col("weight")).otherwise(0.0)).alias("passed_weight")] if "weight" in results.columns else []
    counts = [F.count_if("passed").alias("passed"), F.count("*").alias("total"), *weighted]
    named = [F.col(k) for k in keys]
    return results.groupingSets([[*named, F.col("category")], named], *named, F.col("category")).agg(*counts)


def checks_by_task(checks: DataFrame) -> DataFrame:
    """Numbers of prep and md checks; a check without a category counts as neither."""
    return checks.groupBy("task_id").agg(F.count_if(F.col("category") == "prep").alias("prep"), F.count_if(F.col("category") == "md").alias("md"))


def parameter(checks: DataFrame, check_id: str, *fields: str, required: bool = False):
    """Fields of the first check with the id; None, or KeyError if required, when there is none."""
    row = checks.where(F.col("check_id") == check_id).select(*fields).first()
    if row is None and required:
        raise KeyError(f"the contract has no check {check_id}")
    return row


def verdicts(results: DataFrame, column: str, *keys: str) -> DataFrame:
    """all_passed of each key, or of all rows; of no rows it is true."""
    return results.groupBy(*keys).agg(F.coalesce(F.bool_and(column), F.lit(True)).alias("all_passed"))


def all_true(results: DataFrame, column: str) -> bool:
    return bool(verdicts(results, column).first()[0])


def same_sets(a: DataFrame, b: DataFrame) -> bool:
    """Whether two one-column tables hold the same values equally often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def pooled(**replicas: DataFrame) -> DataFrame:
    """All replicas' rows with their replica_id."""
    out = None
    for name, df in replicas.items():
        part = df.withColumn("replica_id", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def containing(docs: DataFrame, tokens: DataFrame, token_id: str, doc_id: str = "doc_id", max_chars: int = 8_000_000) -> DataFrame:
    """doc_id and token_id of every text that holds a token (token_id, token), case-folded; a null holds and is held by nothing.

    One pass of a string-matching automaton over the texts for each block of at most `max_chars`
    characters of tokens, so the cost grows with the texts alone. Tokens are a stated query set.
    """
    spark = docs.sparkSession
    low = tokens.select(F.col(token_id).alias("i"), F.lower("token").alias("t")).where("t is not null")
    blocks = max(1, -(-(low.agg(F.sum(F.length("t") + 1)).first()[0] or 0) // max_chars))
    src = docs.select(F.col(doc_id).alias("d"), F.lower("text").alias("t")).where("t is not null")
    kinds = f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, {token_id} {tokens.schema[token_id].dataType.simpleString()}"
    id_type = to_arrow_type(tokens.schema[token_id].dataType)

    def block(b: int) -> DataFrame:
        part = [tuple(r) for r in low.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b).collect()]
        return src.mapInArrow(_matcher(spark.sparkContext.broadcast((uuid.uuid4().hex, part)), doc_id, token_id, id_type), kinds)

    return reduce(DataFrame.union, map(block, range(blocks)))


_built: dict[str, tuple] = {}


def _automaton(name: str, tokens: list[tuple]) -> tuple:
    """(ids of the empty token, ids by token, automaton) of a block of tokens, built once in a process; an earlier block's makes room."""
    if name not in _built:
        import ahocorasick

        of: dict[str, list] = {}
        for i, t in tokens:
            of.setdefault(t, []).append(i)
        always, words = of.pop("", []), ahocorasick.Automaton()
        for t, ids in of.items():
            words.add_word(t, ids)
        words.make_automaton()
        _built.clear()
        _built[name] = always, of, words
    return _built[name]


def _matcher(sent, doc_id: str, token_id: str, id_type):
    def run(batches):
        import pyarrow as pa

        always, of, words = _automaton(*sent.value)
        for b in batches:
            at, found = [], []
            for k, text in enumerate(b.column(1)):
                hits = {id(ids): ids for _, ids in words.iter(text.as_py())} if of else {}
                got = [*always, *(i for ids in hits.values() for i in ids)]
                at += [k] * len(got)
                found += got
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(found, id_type)], [doc_id, token_id])

    return run
