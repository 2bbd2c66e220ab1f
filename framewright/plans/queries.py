"""Every operator over the driver's tables, beside DuckDB SQL with the same rows where SQL can express it.

The tables stand in for trajectory data: an event is an atom or a frame of the tracer `user_id`,
an embedding's first 63 numbers are 21 pseudo-atoms of one frame, and orders, parts and
documents stand in for nodes, checks and projects.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.functions import scalars as fn
from framewright.operators import controls, linalg, nulls, order, relational, series
from framewright.plans import catalog
from framewright.sources.pdb import parse_atoms

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of Tables under its name, with its SQL."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def atoms(t: Tables) -> DataFrame:
    """Events as atoms: event type = chain, user = residue."""
    e = t.events
    return e.select(F.col("event_id").alias("ordinal"), F.col("event_type").alias("chain"), F.col("user_id").cast("string").alias("resid"), F.substring("event_type", 1, 2).alias("atom_name"), F.col("value").alias("x"), (F.col("value") * 2).alias("y"), F.lit(0.0).alias("z"), F.when(F.col("event_type") == "error", "H").otherwise("C").alias("element"), F.col("event_type").alias("resname"))


def positions(t: Tables) -> DataFrame:
    """Events as positions: one trajectory, a tracer for each user, frames in time order, a box of 100."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    v = F.col("value")
    return t.events.select(F.lit("t").alias("traj_id"), F.col("user_id").alias("tracer"), (F.row_number().over(w) - 1).alias("frame"), F.lit(100.0).alias("box"), v.alias("x"), (v * 2).alias("y"), (v * 3).alias("z"))


_POS = "pos AS (SELECT user_id AS tracer, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame, value AS x FROM events)"
_STEP = _POS + """, d AS (SELECT tracer, frame, x - lag(x) OVER w AS d1, 2*x - lag(2*x) OVER w AS d2, 3*x - lag(3*x) OVER w AS d3 FROM pos WINDOW w AS (PARTITION BY tracer ORDER BY frame)),
step AS (SELECT tracer, frame, d1 - 100*round_even(d1/100.0, 0)::DOUBLE AS d1, d2 - 100*round_even(d2/100.0, 0)::DOUBLE AS d2, d3 - 100*round_even(d3/100.0, 0)::DOUBLE AS d3 FROM d WHERE d1 IS NOT NULL),
walk AS (SELECT tracer, frame, sum(d1) OVER w AS w1, sum(d2) OVER w AS w2, sum(d3) OVER w AS w3 FROM step WINDOW w AS (PARTITION BY tracer ORDER BY frame ROWS UNBOUNDED PRECEDING))"""


def vectors(t: Tables) -> DataFrame:
    """Embeddings as frames (traj_id = label, frame = vec_id, xyz = first 63 numbers)."""
    return t.embeddings.select(F.concat(F.lit("label"), F.col("label").cast("string")).alias("traj_id"), F.col("vec_id").cast("int").alias("frame"), F.slice("embedding", 1, 63).cast("array<double>").alias("xyz"))


# --- counting and matching ---------------------------------------------------------------------


@query("SELECT l_returnflag, count(DISTINCT (l_linestatus, l_linenumber)) AS residues, count(DISTINCT l_linestatus) AS chains, count(*) AS atoms FROM lineitem GROUP BY 1")
def distinct_composite_count(t):
    rows = t.lineitem.select("l_returnflag", F.col("l_linestatus").alias("chain"), F.col("l_linenumber").cast("string").alias("resid"), F.lit("C").alias("element"))
    return relational.composition(rows, "l_returnflag").select("l_returnflag", "residues", "chains", "atoms")


@query("SELECT count_if(event_type <> 'error')::BIGINT AS heavy, count(*) AS atoms, count(DISTINCT (event_type, user_id)) AS residues, count(DISTINCT event_type) AS chains FROM events")
def heavy_atom_composition(t):
    return relational.composition(atoms(t))


@query("SELECT event_type AS chain, user_id::VARCHAR AS resid, count(*) AS heavy FROM events WHERE event_type <> 'error' GROUP BY 1, 2")
def heavy_by_residue(t):
    return relational.heavy_by_residue(atoms(t))


@query("SELECT c_custkey, coalesce(n, 0)::BIGINT AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE coalesce(n, 0) <> 9")
def per_key_count_left_join_default(t):
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return relational.unlike(t.customer.select("c_custkey"), counts, "c_custkey", "n", F.lit(9)).withColumnRenamed("n", "n_orders")


@query("SELECT 'click:' || u AS key, coalesce(n, 0)::BIGINT AS heavy FROM (SELECT DISTINCT user_id AS u FROM events) LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) ON user_id = u WHERE coalesce(n, 0) <> 13")
def incomplete_residues(t):
    expected = t.events.select(F.concat_ws(":", F.lit("click"), F.col("user_id").cast("string")).alias("key")).distinct()
    return relational.incomplete_residues(atoms(t), expected, F.lit(13))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def keyed_lookup_first_wins(t):
    return relational.keep_first(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def keyed_lookup_last_wins(t):
    return relational.keep_last(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT c_custkey AS k, c_custkey::VARCHAR AS resid, 'cl' AS atom_name, c_acctbal AS x, (SELECT min(event_id) FROM events WHERE user_id = c_custkey AND event_type = 'click') AS own_ordinal FROM customer")
def contract_resolution(t):
    contract = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("resid"), F.lit("cl").alias("atom_name"), F.col("c_acctbal").alias("x"))
    return relational.resolve_contract(contract, atoms(t))


@query("SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'purchase' AND value > 100)")
def missing_keys_anti(t):
    contract = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("resid"), F.lit("pu").alias("atom_name"))
    return relational.missing_contract(contract, atoms(t).where("x > 100")).select("k")


@query("SELECT o_custkey AS job, o_orderpriority AS node_type, max(o_orderkey::VARCHAR) AS node FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2")
def latest_completed(t):
    from framewright.sources.jobs import latest_completed as latest

    nodes = t.orders.select(F.col("o_custkey").alias("job"), F.col("o_orderpriority").alias("node_type"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"), F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderkey").cast("string").alias("node"), F.col("o_totalprice").alias("metadata"))
    return latest(nodes).select("job", "node_type", "node")


@query("SELECT a, b, distance FROM (SELECT c_custkey::VARCHAR AS a, (c_custkey + 1)::VARCHAR AS b, round(sqrt(power(p.v - q.v, 2) * 5), 6) AS distance FROM customer LEFT JOIN (SELECT user_id, arg_max(value, event_id) AS v FROM events WHERE event_type = 'view' GROUP BY 1) p ON p.user_id = c_custkey LEFT JOIN (SELECT user_id, arg_max(value, event_id) AS v FROM events WHERE event_type = 'view' GROUP BY 1) q ON q.user_id = c_custkey + 1) WHERE distance IS NULL OR distance > 100")
def broken_pairs(t):
    pairs = t.customer.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))
    return relational.broken_pairs(atoms(t), pairs, F.lit(100.0), "vi").select("a", "b", F.round("distance", 6).alias("distance"))


@query("SELECT source, lang AS category, count_if(quality = 1)::BIGINT AS passed, count(*) AS total FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((source, lang), (source))")
def category_rollup(t):
    rows = t.documents.select("doc_id", "source", "lang").join(t.labels, "doc_id").select("source", F.col("lang").alias("category"), (F.col("quality") == 1).alias("passed"))
    return relational.category_rollup(rows, ["source"])


@query("SELECT p_type AS task_id, count_if(p_brand < 'Brand#2')::BIGINT AS prep, count_if(p_brand >= 'Brand#2' AND p_size > 25)::BIGINT AS md FROM part GROUP BY 1")
def checks_by_task(t):
    rows = t.part.select(F.col("p_type").alias("task_id"), F.when(F.col("p_brand") < "Brand#2", "prep").when(F.col("p_size") > 25, "md").alias("category"))
    return relational.checks_by_task(rows)


@query("SELECT doc_id AS check_id, coalesce(CASE WHEN toxic = 1 THEN 'md' WHEN toxic = 0 THEN 'clean' END, 'prep') AS category FROM documents LEFT JOIN labels USING (doc_id)")
def default_category_left_join(t):
    known = t.labels.select(F.col("doc_id").alias("check_id"), F.when(F.col("toxic") == 1, "md").otherwise("clean").alias("category"))
    return relational.with_category(t.documents.select(F.col("doc_id").alias("check_id")), known)


@query("SELECT p_brand, p_name, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1")
def parameter_lookup(t):
    return relational.keep_first(t.part.select("p_brand", "p_partkey", "p_name", "p_retailprice"), ["p_brand"], "p_partkey").drop("p_partkey")


@query("SELECT user_id, bool_and(value < 480) AS all_passed FROM events GROUP BY 1")
def all_verdicts(t):
    return relational.verdicts(t.events.select("user_id", (F.col("value") < 480).alias("ok")), "ok", "user_id")


@query("SELECT l_suppkey, round(sum(l_quantity * (CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END)), 4) AS charge, abs(sum(l_quantity * (CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END))) < 100.5 AS neutral FROM lineitem GROUP BY 1")
def neutrality_sum(t):
    charge = F.col("l_quantity") * F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1)
    return relational.net_charge(t.lineitem, charge, 100.5, "l_suppkey").withColumn("charge", F.round("charge", 4))


# --- predicates and scalars --------------------------------------------------------------------


@query("SELECT p_partkey, p_size BETWEEN 11 AND 28 AS in_band, p_retailprice >= 1000.0 AS long_enough, abs(p_size - 25) <= 1 AND p_type = 'ECONOMY' AS matches FROM part")
def band_and_tolerance(t):
    return t.part.select("p_partkey", fn.band(F.col("p_size"), 11, 28).alias("in_band"), (F.col("p_retailprice") >= 1000.0).alias("long_enough"), fn.all_of(fn.within(F.col("p_size"), 25, 1), F.col("p_type").eqNullSafe("ECONOMY")).alias("matches"))


@query("SELECT o_orderkey, coalesce(abs(o_totalprice - a) / a <= 0.25, false) AS close FROM orders JOIN (SELECT o_orderpriority, avg(o_totalprice) AS a FROM orders GROUP BY 1) USING (o_orderpriority)")
def relative_tolerance_match(t):
    ref = t.orders.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("a"))
    return t.orders.join(F.broadcast(ref), "o_orderpriority").select("o_orderkey", fn.relative_within(F.col("o_totalprice"), F.col("a"), 0.25).alias("close"))


@query("SELECT doc_id, contains(lower(text), 'license') AND contains(lower(text), 'mit') AS matches, regexp_matches(text, '(?i)CC BY|CC0|Creative Commons') AS licensed, regexp_full_match(sha256(text), '[0-9a-f]{64}') AS digest_ok FROM documents")
def text_predicates(t):
    x = F.col("text")
    return t.documents.select("doc_id", (fn.folded_contains(x, F.lit("LICENSE")) & fn.folded_contains(x, F.lit("mit"))).alias("matches"), fn.is_licensed(x).alias("licensed"), fn.is_digest(F.sha2(x, 256)).alias("digest_ok"))


@query("SELECT c_custkey, trim(substr(c_name, 1, 9)) AS name, substr(c_name, 10, 9)::BIGINT AS resid, upper(substr(lower(c_mktsegment), 1, 1)) AS element FROM customer")
def fixed_width_parse(t):
    n = F.col("c_name")
    return t.customer.select("c_custkey", fn.strip(fn.field(n, 1, 9)).alias("name"), fn.strip(fn.field(n, 10, 18)).cast("long").alias("resid"), F.upper(F.substring(F.lower("c_mktsegment"), 1, 1)).alias("element"))


@query("SELECT s_suppkey AS ordinal_key, 0 AS ordinal, chr(65 + s_nationkey) AS chain, s_suppkey::VARCHAR AS resid, 'CA' AS atom_name, s_acctbal::DECIMAL(18,3)::DOUBLE AS x, 'C' AS element, 'ALA' AS resname FROM supplier")
def pdb_parse(t):
    line = F.format_string("ATOM  %5d  CA  ALA %s%4d    %8.3f%8.3f%8.3f  1.00  0.00           C", F.col("s_suppkey"), F.chr(F.col("s_nationkey") + 65), F.col("s_suppkey"), "s_acctbal", F.lit(0.0), F.lit(0.0))
    files = t.supplier.select(F.concat(F.lit("HEADER\r\n"), line, F.lit("\r\nTER\r\n")).alias("value"), F.col("s_suppkey").alias("file"))
    return parse_atoms(files).select(F.col("file").alias("ordinal_key"), "ordinal", "chain", "resid", "atom_name", "x", "element", "resname")


@query("SELECT s_nationkey AS file, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS ordinal, s_suppkey::VARCHAR AS resid, s_acctbal::DECIMAL(18,3)::DOUBLE AS x FROM supplier")
def pdb_ordinals(t):
    """A file for each nation, an atom for each supplier, other records between them."""
    record = F.when(F.col("s_suppkey") % 3 == 0, "HETATM").otherwise("ATOM  ")
    line = F.concat(record, F.format_string("%5d  CA  ALA A%4d    %8.3f%8.3f%8.3f  1.00  0.00           C\n", F.col("s_suppkey") % 100000, F.col("s_suppkey"), "s_acctbal", F.lit(0.0), F.lit(0.0)), F.when(F.col("s_suppkey") % 4 == 0, "ANISOU x\nTER\n").otherwise(""))
    files = t.supplier.groupBy(F.col("s_nationkey").alias("file")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("line")))).alias("rows"))
    return parse_atoms(files.select("file", F.concat(F.lit("REMARK\n"), F.array_join("rows.line", "")).alias("value"))).select("file", F.col("ordinal").cast("long").alias("ordinal"), "resid", "x")


@query("SELECT p_partkey, ['HOH', 'TIP3', 'ALA', 'HSE', 'LIG'][p_size % 5 + 1] IN ('HOH', 'TIP3') AND p_partkey % 3 = 0 AS water_oxygen, ['HOH', 'TIP3', 'ALA', 'HSE', 'LIG'][p_size % 5 + 1] IN ('ALA', 'HSE') AS protein FROM part")
def solvent_and_protein(t):
    of = lambda names, i: F.get(F.array(*map(F.lit, names)), i)
    resname, atom = of(("HOH", "TIP3", "ALA", "HSE", "LIG"), F.col("p_size") % 5), of(("O", "OW", "CA"), (F.col("p_partkey") % 3).cast("int"))
    return t.part.select("p_partkey", fn.is_water_oxygen(resname, atom).alias("water_oxygen"), fn.is_protein(resname).alias("protein"))


@query("SELECT user_id, count(*) AS checks, (sum((props->>'k')::INTEGER))::BIGINT AS total, max((props->>'k')::INTEGER) AS most, count_if((props->'missing') IS NOT NULL)::BIGINT AS other FROM events GROUP BY 1")
def json_parameters(t):
    """Parameters of checks as a map, by name."""
    given = F.from_json("props", "map<string,int>")
    rows = t.events.select("user_id", F.element_at(given, "k").alias("k"), F.map_contains_key(given, F.lit("missing")).alias("m"))
    return rows.groupBy("user_id").agg(F.count("*").alias("checks"), F.sum("k").alias("total"), F.max("k").alias("most"), F.count_if("m").alias("other"))


@query("SELECT doc_id, item_id FROM documents JOIN benchmark ON contains(lower(documents.text), lower(benchmark.text))")
def leak_scan(t):
    return relational.containing(t.documents.select("doc_id", "text"), t.benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("token")), "item_id")


@query("SELECT doc_id, sha256(text) AS digest, strlen(text)::BIGINT AS length, strlen(text)::BIGINT // 48 AS frames FROM documents")
def content_sha256(t):
    n = F.octet_length("text").cast("long")
    return t.documents.select("doc_id", F.sha2("text", 256).alias("digest"), n.alias("length"), F.floor(n / 48).alias("frames"))


@query("WITH n AS (SELECT greatest(1, count(*) // 500) AS step FROM events) SELECT event_id, value FROM events, n WHERE event_id % step = 0")
def stride_select(t):
    selector = fn.stride(t.events.count(), 500)
    return t.events.where(fn.selected(F.col("event_id") + 1, selector)).select("event_id", "value")


@query("WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame, value FROM events) SELECT name AS traj_id, user_id, frame, value FROM f JOIN (VALUES ('full', 2147483647), ('ten', 10), ('thirty', 30)) l(name, n) ON frame < n")
def prefix_truncation(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    frames = t.events.select(F.lit("x").alias("traj_id"), "user_id", (F.row_number().over(w) - 1).cast("long").alias("frame"), "value")
    return controls.truncated(frames, {"full": 2**31 - 1, "ten": 10, "thirty": 30}).select("traj_id", "user_id", "frame", "value")


@query("SELECT o_orderkey, printf('%.3f of %d', o_totalprice, o_custkey) AS detail FROM orders")
def detail_format(t):
    return t.orders.select("o_orderkey", F.format_string("%.3f of %d", "o_totalprice", "o_custkey").alias("detail"))


# --- series ------------------------------------------------------------------------------------


@query(f"WITH {_STEP} SELECT tracer, frame, round(w1, 6) AS wx, round(w2, 6) AS wy, round(w3, 6) AS wz FROM walk")
def unwrap_walk(t):
    r = lambda c: F.round(c, 6).alias(c)
    return series.walks(positions(t)).select("tracer", F.col("frame").cast("long").alias("frame"), r("wx"), r("wy"), r("wz"))


@query("SELECT user_id, n::INTEGER AS n_frames, list_distinct(list_transform(range(0, least(40, greatest(2, (n - 1) // 5))), lambda i: CASE WHEN i = least(40, greatest(2, (n - 1) // 5)) - 1 THEN greatest(2, (n - 1) // 5)::INTEGER ELSE trunc(1.0::DOUBLE + i * ((greatest(2, (n - 1) // 5) - 1)::DOUBLE / (least(40, greatest(2, (n - 1) // 5)) - 1)))::INTEGER END)).list_sort() AS lags FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING n >= 5)")
def lag_grid(t):
    """The lags of each user's events as frames."""
    n = t.events.groupBy("user_id").agg(F.count("*").cast("int").alias("n_frames")).where("n_frames >= 5")
    return n.withColumn("lags", F.array_sort(fn.lag_grid(F.col("n_frames"))))


_LAGS = "n AS (SELECT count(DISTINCT frame) + 1 AS n FROM walk), h AS (SELECT greatest(2, (n - 1) // 5) AS h, least(40, greatest(2, (n - 1) // 5)) AS k FROM n), lags AS (SELECT DISTINCT CASE WHEN i = k - 1 THEN h ELSE trunc(1.0::DOUBLE + i * ((h - 1)::DOUBLE / (k - 1)))::BIGINT END AS lag FROM h, range(0, 40) r(i) WHERE i < k)"
_MSD = "msd AS (SELECT lag, avg(power(b.w1 - a.w1, 2) + power(b.w2 - a.w2, 2) + power(b.w3 - a.w3, 2)) AS msd FROM walk a JOIN lags ON true JOIN walk b ON b.tracer = a.tracer AND b.frame = a.frame + lag GROUP BY lag)"


@query(f"WITH {_STEP}, {_LAGS}, {_MSD} SELECT lag::INTEGER AS lag, round(msd, 3) AS msd FROM msd")
def msd_by_lag(t):
    msd = series.msd_of(series.lag_sums(series.dealt_positions(positions(t))))
    return msd.where("lag > 0").select("lag", F.round("msd", 3).alias("msd"))


@query(f"WITH {_STEP}, {_LAGS}, {_MSD}, total AS (SELECT avg(s) AS total FROM (SELECT arg_max(power(w1, 2) + power(w2, 2) + power(w3, 2), frame) AS s FROM walk GROUP BY tracer)) SELECT round(regr_slope(msd, lag * 1.0), 3) AS slope, round(any_value(total), 3) AS total_msd, round(CASE WHEN regr_slope(msd, lag * 1.0) > 0 THEN any_value(total) / regr_slope(msd, lag * 1.0) ELSE 0 END, 4) AS elapsed FROM msd, total")
def clock_elapsed(t):
    """In time ranges of 16 frames, which the walks of some 60 frames fill four times."""
    msd = series.msd_of(series.lag_sums(series.dealt_positions(positions(t)), length=16))
    fit = series.fitted_clock(msd, msd.select("traj_id").distinct().withColumn("dt", F.lit(1.0)))
    return fit.select(F.round("slope", 3).alias("slope"), F.round("total", 3).alias("total_msd"), F.round("elapsed_ps", 4).alias("elapsed"))


@query("WITH f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame FROM events), g AS (SELECT user_id, count(*) AS n_frames, (user_id % 150)::INTEGER AS n_tracers, (max(event_id) FILTER (frame = 1) - max(event_id) FILTER (frame = 0))::DOUBLE AS dt FROM f WHERE event_id % 9 <> 0 OR frame < 2 GROUP BY user_id) SELECT user_id::VARCHAR AS traj_id, n_frames, n_tracers, dt, CASE WHEN n_tracers < 100 THEN 'only ' || n_tracers || ' solvent atoms' WHEN n_frames < 5 THEN 'only ' || n_frames || ' frames' END AS reason FROM g")
def clock_facts(t):
    """What a clock needs to know of each user's events as frames, and why it can't be read."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = t.events.withColumn("frame", F.row_number().over(w) - 1).where("event_id % 9 <> 0 OR frame < 2")
    frames = rows.select(F.col("user_id").cast("string").alias("traj_id"), "frame", F.col("event_id").cast("double").alias("time_ps"), F.array_repeat("value", (F.col("user_id") % 150 * 3).cast("int")).alias("tracer_nm"))
    return series.facts(frames).withColumn("reason", series.guard(F.col("n_tracers"), F.col("n_frames")))


@query("SELECT vec_id::INTEGER AS frame, round(sqrt(var_pop(embedding[3*i+1]::DOUBLE) + var_pop(embedding[3*i+2]::DOUBLE) + var_pop(embedding[3*i+3]::DOUBLE)), 8) AS rg FROM embeddings, range(0, 21) r(i) GROUP BY vec_id")
def gyration_by_frame(t):
    frames = vectors(t).select("traj_id", "frame", F.col("xyz").alias("protein_nm"))
    return series.radii_of_gyration(frames).select("frame", F.round("rg", 8).alias("rg"))


@query("SELECT 'label' || label AS traj_id, round(avg(rg), 8) AS rg FROM (SELECT label, vec_id, sqrt(var_pop(embedding[3*i+1]::DOUBLE) + var_pop(embedding[3*i+2]::DOUBLE) + var_pop(embedding[3*i+3]::DOUBLE)) AS rg FROM embeddings, range(0, 21) r(i) GROUP BY 1, 2) GROUP BY 1")
def gyration_by_group(t):
    from framewright.sources.frames import long_frames

    return series.radii_of_gyration_long(long_frames(vectors(t))).groupBy("traj_id").agg(F.round(F.avg("rg"), 8).alias("rg"))


@query("WITH f AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 20 AS block, value FROM events) SELECT user_id, block, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM f GROUP BY 1, 2")
def block_windows(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    f = t.events.select("user_id", F.floor((F.row_number().over(w) - 1) / 20).alias("block"), "value")
    return f.groupBy("user_id", "block").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("sd"))


@query("WITH c AS (SELECT event_type, event_id, value - avg(value) OVER (PARTITION BY event_type) AS x FROM events), p AS (SELECT event_type, lag, x * lead(x, lag) OVER (PARTITION BY event_type, lag ORDER BY event_id) AS xy FROM c, range(0, 6) r(lag)), g AS (SELECT event_type, lag, avg(xy) AS c FROM p GROUP BY 1, 2) SELECT a.event_type, a.lag::INTEGER AS lag, round(a.c / z.c, 6) AS acf FROM g a JOIN g z ON z.event_type = a.event_type AND z.lag = 0")
def autocorrelation(t):
    return catalog.autocorrelation(t.events, ["event_type"], "event_id", "value", 5).select("event_type", "lag", F.round("acf", 6).alias("acf"))


# --- linear algebra and nulls ------------------------------------------------------------------


@query("SELECT label, i::INTEGER AS dim, round(avg(embedding[i]::DOUBLE), 8) AS mean FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2")
def centroid_by_label(t):
    x = t.embeddings.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    return x.groupBy("label", (F.col("i") + 1).alias("dim")).agg(F.round(F.avg("v"), 8).alias("mean"))


_COV = "SELECT i::INTEGER AS i, j::INTEGER AS j, round(covar_pop(embedding[i]::DOUBLE, embedding[j]::DOUBLE), 9) + 0.0 AS c FROM embeddings, range(1, 64) a(i), range(1, 64) b(j) GROUP BY 1, 2"


@query(_COV)
def covariance_matrix(t):
    c = linalg.covariance(vectors(t))
    rows = [(i + 1, j + 1, float(x)) for (i, j), x in np.ndenumerate(c)]
    return t.spark.createDataFrame(rows, "i int, j int, c double").select("i", "j", (F.round("c", 9) + F.lit(0.0)).alias("c"))


@query("SELECT round(sum(v), 8) AS total_variance FROM (SELECT var_pop(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 64) r(i) GROUP BY i)")
def total_variance(t):
    x = vectors(t).select(F.posexplode("xyz").alias("i", "v")).groupBy("i").agg(F.var_pop("v").alias("v"))
    return x.agg(F.round(F.sum("v"), 8).alias("total_variance"))


_MODES = "m AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS mode FROM embeddings), top AS (SELECT * FROM m WHERE mode <= 10)"


@query(f"WITH {_MODES} SELECT 'label' || a.label AS \"left\", 'label' || b.label AS \"right\", round(sqrt(sum(power(list_dot_product(a.v[1:63], b.v[1:63]), 2)) / 10), 8) AS rmsip FROM top a, top b GROUP BY 1, 2")
def frame_overlap(t):
    w = Window.partitionBy("traj_id").orderBy("frame")
    u = vectors(t).select("traj_id", (F.row_number().over(w) - 1).alias("mode"), F.col("xyz").alias("vector"))
    return linalg.overlaps(u, u).select("left", "right", F.round("rmsip", 8).alias("rmsip"))


_SITES = "s AS (SELECT label, vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), p AS (SELECT a.label, a.vec_id AS site, b.vec_id AS other, b.x-a.x AS dx, b.y-a.y AS dy, b.z-a.z AS dz, power(a.x-b.x,2)+power(a.y-b.y,2)+power(a.z-b.z,2) AS sq FROM s a JOIN s b USING (label))"


def _sites(t: Tables) -> DataFrame:
    e = F.col("embedding")
    return t.embeddings.select(F.col("label").alias("structure"), F.col("vec_id").alias("site"), *[e[i].cast("double").alias(a) for i, a in enumerate("xyz")])


@query(f"WITH {_SITES} SELECT label AS structure, round((0.05 + 0.01 * k)::DOUBLE, 2) AS cutoff, count(*) AS contacts FROM p, range(0, 27) r(k) WHERE sq > 0 AND sq <= power(0.05 + 0.01 * k, 2) GROUP BY 1, 2")
def contact_sweep(t):
    return nulls.contact_counts(_sites(t), [round(0.05 + 0.01 * k, 2) for k in range(27)])


@query(f"WITH {_SITES} SELECT site, round(sum(dx*dx/sq), 6) AS hxx, round(sum(dx*dy/sq), 6) AS hxy, round(sum(dz*dz/sq), 6) AS hzz FROM p WHERE sq > 0 AND sq <= 0.04 GROUP BY 1")
def hessian_blocks(t):
    h = lambda c: F.round(F.sum(c), 6).alias(c)
    return nulls.site_hessians(_sites(t), 0.2).groupBy("site").agg(h("hxx"), h("hxy"), h("hzz"))


_NETWORK = """WITH f AS (SELECT label, embedding FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
s AS (SELECT label, i, embedding[3*i+1]::DOUBLE AS x, embedding[3*i+2]::DOUBLE AS y, embedding[3*i+3]::DOUBLE AS z FROM f, range(0, 21) r(i)),
p AS (SELECT a.label, a.i, b.i AS j, [a.x-b.x, a.y-b.y, a.z-b.z] AS d, power(a.x-b.x, 2) + power(a.y-b.y, 2) + power(a.z-b.z, 2) AS sq FROM s a JOIN s b ON a.label = b.label),
o AS (SELECT label, i, j, a, b, -d[a+1] * d[b+1] / sq AS v FROM p, range(0, 3) q(a), range(0, 3) w(b) WHERE sq > 0 AND sq <= 0.45 * 0.45),
e AS (SELECT * FROM o UNION ALL SELECT label, i, i, a, b, -sum(v) FROM o GROUP BY label, i, a, b)
SELECT 'label' || label AS structure, (3 * i + a)::INTEGER AS i, (3 * j + b)::INTEGER AS j, round(v, 8) AS dense, round(v, 8) AS sparse FROM e WHERE abs(v) > 1e-6"""


@query(_NETWORK)
def network_hessian(t):
    """The network of each label's first frame, as a dense matrix and by the sparse network's products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, flat in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                coords = flat.values.to_numpy(zero_copy_only=False).reshape(-1, 3)
                dense, sparse = nulls.hessian(coords, 0.45), nulls.SparseNetwork(coords, 0.45).times(np.eye(coords.size))
                i, j = np.nonzero(np.maximum(np.abs(dense), np.abs(sparse)) > 1e-6)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(i)), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(dense[i, j]), pa.array(sparse[i, j])], ["structure", "i", "j", "dense", "sparse"])

    got = _targets(t).select("traj_id", "aim").mapInArrow(run, "structure string, i int, j int, dense double, sparse double")
    return got.withColumns({c: F.round(c, 8) + F.lit(0.0) for c in ("dense", "sparse")})


@query("SELECT event_type, observed, round(avg(value), 8) AS null_mean, round(stddev_pop(value), 8) AS null_sd, max(value) AS null_max, round((observed - avg(value)) / stddev_pop(value), 8) AS z_score, round((count_if(value >= observed) + 1) / (count(*) + 1), 10) AS p_value_upper_bound, observed > max(value) AS h0_rejected FROM events JOIN (SELECT event_type, quantile_cont(value, 0.99) AS observed FROM events GROUP BY 1) USING (event_type) GROUP BY 1, 2")
def null_summary(t):
    observed = t.events.groupBy("event_type").agg(F.percentile("value", 0.99).alias("observed"))
    got = nulls.compared(t.events.select("event_type", "value"), observed, ["event_type"], "value")
    r = lambda c, k=8: F.round(c, k).alias(c)
    return got.select("event_type", "observed", r("null_mean"), r("null_sd"), "null_max", r("z_score"), r("p_value_upper_bound", 10), "h0_rejected")


@query("SELECT event_type, round(quantile_cont(value, 0.999), 9) AS cut, round(quantile_cont(value, 0.99), 9) AS per_mode_cut FROM events GROUP BY 1")
def null_quantile(t):
    q = order.exact_quantiles(t.events, ["event_type"], "value", [0.999, 0.99])
    return q.select("event_type", F.round(F.get("quantiles", F.lit(0)), 9).alias("cut"), F.round(F.get("quantiles", F.lit(1)), 9).alias("per_mode_cut"))


@query("SELECT user_id::VARCHAR AS structure, max(value) AS floor, arg_max(event_id, (value, -event_id))::DOUBLE AS best_cutoff FROM events GROUP BY 1")
def argmax_cutoff(t):
    null = t.events.select(F.col("user_id").cast("string").alias("structure"), F.col("event_id").alias("at"), F.col("event_id").cast("double").alias("cutoff"), F.col("value").alias("rmsip"))
    return nulls.null_floor(null).select("structure", "floor", "best_cutoff")


# --- sorts, sets, catalogue --------------------------------------------------------------------


@query("SELECT user_id, rank, value FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS rank FROM events) WHERE rank < 10")
def top_modes(t):
    got = relational.first_of(t.events.select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.col("event_id")], 10)
    return got.select("user_id", F.col("rank").cast("long").alias("rank"), "value")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 6")
def offset_modes(t):
    return t.customer.select("c_custkey", "c_acctbal").orderBy("c_acctbal", "c_custkey").offset(6).limit(10)


@query("SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey)[1:4] AS first_four FROM orders GROUP BY 1")
def first_missing(t):
    four = relational.first_of(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], [F.col("o_orderkey")], 4)
    return four.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("first_four"))


@query("SELECT 'a' AS replica_id, c_custkey AS id, c_acctbal AS v FROM customer UNION ALL SELECT 'b', s_suppkey, s_acctbal FROM supplier")
def pool_replicas(t):
    return relational.pooled(a=t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v")), b=t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v"))).select("replica_id", "id", "v")


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) = 0 AND (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) = 0 AS same")
def set_equality(t):
    same = relational.same_sets(t.orders.select("o_custkey").distinct(), t.customer.select("c_custkey"))
    return t.spark.createDataFrame([(same,)], "same boolean")


@query("SELECT lang, count(*) AS projects FROM documents WHERE regexp_matches(text, '(?i)CC BY|CC0|Creative Commons') AND n_chars > 200 AND source <> 'src0' GROUP BY 1")
def eligible_projects(t):
    ok = catalog.eligible(t.documents, "text", F.col("n_chars") > 200, F.col("source") != "src0", F.col("doc_id").isNotNull())
    return catalog.histogram(ok, F.col("lang"), "lang")


@query("SELECT 'mail' AS axis, count_if(contains(text, '@'))::BIGINT AS projects FROM documents UNION ALL SELECT 'long', count_if(n_chars > 2000)::BIGINT FROM documents UNION ALL SELECT 'english', count_if(lang = 'en')::BIGINT FROM documents")
def capability_axes(t):
    return catalog.by_axis(t.documents, mail=F.contains(F.col("text"), F.lit("@")), long=F.col("n_chars") > 2000, english=F.col("lang") == "en")


@query("SELECT CASE WHEN regexp_matches(text, '(?i)CC0') THEN 'CC0' WHEN regexp_matches(text, '(?i)CC BY|Creative Commons') THEN 'CC-BY' ELSE 'other' END AS licence, count(*) AS projects FROM documents GROUP BY 1")
def licence_histogram(t):
    return catalog.histogram(t.documents, catalog.licence_class(F.col("text")), "licence")


@query("SELECT regexp_replace(n, '-[0-9]+$', '') AS name, count(DISTINCT user_id) AS projects FROM (SELECT user_id, unnest([event_type || '-01', event_type || '-02']) AS n FROM events) GROUP BY 1")
def analyses_by_prefix(t):
    rows = t.events.select("user_id", F.array(F.concat("event_type", F.lit("-01")), F.concat("event_type", F.lit("-02"))).alias("names"))
    return catalog.by_name_prefix(rows, "user_id", "names")


@query("SELECT turns, count(*) AS projects FROM (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1 HAVING count(*) >= 2) GROUP BY 1")
def replica_histogram(t):
    n = t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns")).where("turns >= 2")
    return catalog.histogram(n, F.col("turns"), "turns")


@query('SELECT l_partkey, count(DISTINCT l_suppkey) AS "values" FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2')
def multi_force_field_groups(t):
    return catalog.differing_groups(t.lineitem, "l_partkey", "l_suppkey")


@query("SELECT count_if(p_size > 40)::BIGINT AS by_size, count_if(contains(p_name, 'ring'))::BIGINT AS by_name, count_if(p_size > 40 OR contains(p_name, 'ring'))::BIGINT AS by_either FROM part")
def three_definitions(t):
    size, name = F.col("p_size") > 40, F.contains(F.col("p_name"), F.lit("ring"))
    return t.part.agg(F.count_if(size).alias("by_size"), F.count_if(name).alias("by_name"), F.count_if(size | name).alias("by_either"))


@query("SELECT round(min((c_acctbal - s_acctbal) / s_acctbal), 8) AS least, round(max((c_acctbal - s_acctbal) / s_acctbal), 8) AS most, count(*) AS modes FROM customer JOIN supplier ON s_suppkey = c_custkey")
def eigenvalue_crosscheck(t):
    got = catalog.crosscheck(t.customer.select(F.col("c_custkey").alias("mode"), F.col("c_acctbal").alias("eigenvalue")), t.supplier.select(F.col("s_suppkey").alias("mode"), F.col("s_acctbal").alias("eigenvalue")))
    return got.select(F.round("least", 8).alias("least"), F.round("most", 8).alias("most"), "modes")


@query("WITH r AS (SELECT p_brand, p_size, p_retailprice, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS a, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2 AS b FROM part) SELECT p_brand, round(corr(p_size, p_retailprice), 8) AS pearson, round(corr(a, b), 8) AS spearman FROM r GROUP BY 1")
def profile_correlation(t):
    got = catalog.profile_correlation(t.part, ["p_brand"], "p_size", "p_retailprice")
    return got.select("p_brand", F.round("pearson", 8).alias("pearson"), F.round("spearman", 8).alias("spearman"))


_AT = str([i / 100 for i in range(101)])


@query(f"SELECT event_type, round(avg(abs(a - b)), 6) AS distance FROM (SELECT event_type, unnest(quantile_cont(value, {_AT}) FILTER (user_id % 2 = 0)) AS a, unnest(quantile_cont(value, {_AT}) FILTER (user_id % 2 = 1)) AS b FROM events GROUP BY 1) GROUP BY 1")
def wasserstein(t):
    got = catalog.wasserstein(t.events, ["event_type"], F.col("user_id") % 2 == 0, "value")
    return got.select("event_type", F.round("distance", 6).alias("distance"))


@query()
def block_bootstrap(t):
    return catalog.block_bootstrap(t.events, "event_id", "value", 100, 200, 20260819)


# --- beyond SQL: superposition, spectra, random draws --------------------------------------------


def _targets(t: Tables) -> DataFrame:
    """(traj_id, aim): the first frame of each label."""
    return relational.keep_first(vectors(t), ["traj_id"], "frame").select("traj_id", F.col("xyz").alias("aim"))


@query()
def kabsch_superpose(t):
    aim = _targets(t).where("traj_id = 'label0'").first()
    return linalg.superposed(vectors(t), np.array(aim.aim).reshape(-1, 3))[0]


@query()
def essential_subspace(t):
    return linalg.essential_subspaces(vectors(t), _targets(t))


@query()
def window_subspaces(t):
    w = Window.partitionBy("traj_id").orderBy("frame")
    frames = vectors(t).withColumn("frame", (F.row_number().over(w) - 1).cast("int"))
    return linalg.window_subspaces(frames, _targets(t), 25)


@query()
def sliding_subspaces(t):
    w = Window.partitionBy("traj_id").orderBy("frame")
    frames = vectors(t).withColumn("frame", (F.row_number().over(w) - 1).cast("int"))
    return linalg.sliding_subspaces(frames, _targets(t), 20, 5).where("mode < 10")


@query()
def mode_correlation_times(t):
    """Integrated autocorrelation times of each label's frames along its first three modes, and the lags that they sum."""
    w = Window.partitionBy("traj_id").orderBy("frame")
    frames = vectors(t).withColumn("frame", (F.row_number().over(w) - 1).cast("int"))
    along = linalg.projections(frames, _targets(t), 3)
    return order.integrated_times(order.autocorrelation(along, ["traj_id", "mode"], "frame", "value", 20), ["traj_id", "mode"])


REACH = [0.35 + 0.01 * i for i in range(27)]


def _sweep(t: Tables, targets: DataFrame, spaces: DataFrame) -> DataFrame:
    """The structure-only null of every label."""
    known = linalg.mode_table(spaces).join(targets, "traj_id").select(F.col("traj_id").alias("structure"), F.col("aim").alias("coords"), "modes")
    return nulls.network_null(t.spark, known, REACH)


@query()
def anm_null(t):
    targets = _targets(t)
    return _sweep(t, targets, linalg.essential_subspaces(vectors(t), targets))


@query()
def random_null(t):
    """Each label's subspace against 200 random frames."""
    spaces = linalg.essential_subspaces(vectors(t), _targets(t))
    return nulls.random_overlaps(linalg.mode_table(spaces).withColumnRenamed("traj_id", "structure"), 200)


@query()
def beyond_structure_test(t):
    """Each label's subspace against those of all other labels, tested against the structure-only null."""
    targets = _targets(t)
    spaces = linalg.essential_subspaces(vectors(t), targets).cache()
    null = _sweep(t, targets, spaces)
    agreed = linalg.overlaps(spaces, spaces).where(F.col("left") != F.col("right"))
    observed = agreed.select(F.col("right").alias("structure"), F.col("left").alias("traj_id"), F.col("rmsip").alias("observed"))
    return nulls.compared(null.select("structure", "rmsip"), observed, ["structure"], draws_fit=True)


@query()
def unrelated_test(t):
    """Each label's subspace against the first label's, tested against random frames."""
    modes = linalg.mode_table(linalg.essential_subspaces(vectors(t), _targets(t))).cache()
    first = modes.where("traj_id = 'label0'").select(F.col("traj_id").alias("right"), F.col("modes").alias("v"))
    pairs = modes.where("traj_id <> 'label0'").select(F.col("traj_id").alias("left"), F.col("modes").alias("u")).crossJoin(first)  # one reference
    return nulls.unrelated_tests(pairs)


def tracers(t: Tables) -> DataFrame:
    """frame, tracer_nm: events as a solvent of 100 tracers, each event one diffusive step of about 0.1 nm; an incomplete last frame is left out."""
    n = series.FEWEST_TRACERS
    scale = F.broadcast(t.events.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd")))
    step = F.coalesce(F.try_divide(F.col("value") - F.col("m"), F.col("sd")), F.lit(0.0)) * 0.1
    rows = t.events.crossJoin(scale).select((F.col("event_id") % n).alias("tracer"), F.floor(F.col("event_id") / n).cast("int").alias("frame"), step.alias("step"))
    w = Window.partitionBy("tracer").orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    places = rows.withColumn("x", F.sum("step").over(w)).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("tracer", "x"))).alias("p"))
    return places.where(F.size("p") == n).select("frame", F.flatten(F.transform("p", lambda p: F.array(p["x"], p["x"] * 2, p["x"] * 3))).alias("tracer_nm"))


def _generated(targets: DataFrame) -> DataFrame:
    """The synthetic baselines of each label's first structure: structure, baseline, frame, xyz."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for label, flat in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for name, xyz in controls.synthetic_baselines(np.array(flat).reshape(-1, 3)).items():
                    n = len(xyz)
                    yield pa.RecordBatch.from_arrays([pa.array([label] * n), pa.array([name] * n), pa.array(range(n), pa.int32()), pa.array(xyz.reshape(n, -1).tolist(), pa.list_(pa.float64()))], ["structure", "baseline", "frame", "xyz"])

    return targets.select("traj_id", "aim").mapInArrow(run, "structure string, baseline string, frame int, xyz array<double>")


@query()
def negative_controls(t):
    """The six baselines of each label, frames of 1 ps, against the label's own subspace and clock."""
    targets = _targets(t)
    w = Window.partitionBy("traj_id").orderBy("frame")
    ranked = vectors(t).withColumn("frame", (F.row_number().over(w) - 1).cast("int")).withColumn("structure", F.col("traj_id"))
    real = controls.truncated(ranked, {"real_full_run": 2**31 - 1, "truncated_100ps": 100, "truncated_10ps": 10}).withColumnRenamed("traj_id", "baseline")
    cases = real.select("structure", "baseline", "frame", "xyz").unionByName(_generated(targets))
    name = F.concat_ws("/", "structure", "baseline").alias("traj_id")
    names = F.explode(F.array(*[F.lit(n) for n, _ in controls.BASELINES])).alias("baseline")
    aims = targets.select(F.col("traj_id").alias("structure"), "aim", names).select(name, "aim")
    spaces = linalg.essential_subspaces(cases.select(name, "frame", "xyz"), aims).cache()
    part = lambda c, i: F.element_at(F.split(c, "/"), i)
    spaces = spaces.withColumn("structure", part("traj_id", 1))
    own = spaces.where(F.endswith("traj_id", F.lit("/real_full_run")))
    null = _sweep(t, targets, own.withColumn("traj_id", F.col("structure")))
    agreed = linalg.overlaps(spaces, own, on="structure")
    observed = agreed.select(part("left", 1).alias("structure"), part("left", 2).alias("baseline"), F.col("rmsip").alias("observed"))
    tests = nulls.compared(null.select("structure", "rmsip"), observed, ["structure"], draws_fit=True).withColumnRenamed("observed", "rmsip")
    timed = real.join(tracers(t), "frame", "left").select(name, "frame", F.col("frame").cast("double").alias("time_ps"), F.lit(100.0).alias("box"), "tracer_nm")
    clocks = series.clocks(timed).withColumns({"structure": part("traj_id", 1), "baseline": part("traj_id", 2)})
    return controls.judged(tests, clocks, 0.5, keys=("structure",))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["beyond_structure_test"](spark, sf_dir)

