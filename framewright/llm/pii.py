"""Operator 7: information-theoretic sanitisation of personal data, in DataFrame operations only.

Base spans of e-mail addresses, IP addresses, card and phone numbers come from regular
expressions with possessive quantifiers and run-start guards (linear in the text, same
matches as the plain expressions), with offsets in code points from the lengths of the
pieces between matches.

The corpus then tells how strongly a term reveals that a protected entity stands in its
document. For a kind k and a term t, over all documents,

    PMI(t; k) = log2(n(t,k) * N / (n(t) * n(k)))  and  IC(k) = log2(N / n(k)),

and PMI / IC is the share of the entity's information that the term discloses; 1 means
that t never occurs without k. Terms beyond `generalise` are replaced by a class name and
terms beyond `remove` are taken out, in documents that hold such an entity. Evidence is
the number of different entities of a kind beside which the term was seen, over all entities
of each document, and the number of different sets of them that its documents held, so any
number of exact or near copies of a document counts once, and one document with many
entities proves nothing for its every word; where either is below `support` nothing is
concluded.

Documents are written once, with their spans and a number, and stay where they are: shuffles carry
terms, counts and numbers only (see `common.Numbered`). n(t) is a map-side combined count over all
documents; pairs come from documents with an entity only. The disclosing terms are sent to the
executors up to BROADCAST_BYTES and joined by sorting beyond.

Nulls and rows: a null text counts as empty and stays null when sanitised; null ids and
repeated rows are each returned; overlapping spans of different kinds are all reported and
replaced as one, by the first's name; a share that equals a threshold counts as beyond it; a text of any length is
taken whole, in time that grows with its length and with the power 1.5 of its spans or disclosing terms; an
empty table gives an empty result; further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Numbered, discard, free_name, written

KINDS = ("email", "ip", "card", "phone")
#: Fixed by the contract, with possessive quantifiers where backing off can never help.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GENERALISE, REMOVE, SUPPORT = 0.9, 0.99, 5
BROADCAST_BYTES = 32_000_000
SPAN = "array<struct<kind:string,s:bigint,e:bigint,m:string>>"
_NONE = F.array


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once: what a lambda's body names from outside is worked out for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, step) -> Column:
    """step(v0, v1), step(that, v2), ... of an array of longs, itself first: running sums or maxima.

    Within blocks of the root of the array's size and then over the blocks, so that extending an array copies
    a block at most, not all that stands before.
    """
    grow = lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) > 0, step(F.element_at(acc, -1), x)).otherwise(x)))
    scan = lambda some: F.aggregate(some, F.array().cast("array<bigint>"), grow)

    def blocks(v: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda b: scan(F.slice(v, b * width + 1, width)))

    def over(own: Column) -> Column:
        ends = scan(F.transform(own, lambda b: F.element_at(b, -1)))
        pairs = F.filter(F.arrays_zip(own.alias("own"), F.concat(F.array(F.lit(None).cast("bigint")), ends).alias("before")), lambda p: p["own"].isNotNull())
        return F.flatten(F.transform(pairs, lambda p: F.when(p["before"].isNull(), p["own"]).otherwise(F.transform(p["own"], lambda x: step(p["before"], x)))))

    return let(values, lambda v: F.when(F.size(v) > 0, let(blocks(v), over)).otherwise(F.array().cast("array<bigint>")))


def _located(text: Column, found: Column, pattern: Column, kind: str) -> Column:
    """Spans of the matches `found` of `pattern`."""
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    ends = running(F.zip_with(gaps, found, lambda g, m: (F.length(g) + F.length(m)).cast("bigint")), lambda a, b: a + b)
    span = lambda e, m: F.struct(F.lit(kind).alias("kind"), (e - F.length(m)).alias("s"), e.alias("e"), m.alias("m"))
    return F.when(F.size(found) > 0, F.zip_with(ends, found, span)).otherwise(F.array().cast(SPAN))


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        back = F.reverse(digits)
        digit = lambda i: F.substring(back, i, F.lit(1)).cast("int")
        twice = lambda i: digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0)
        total = F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, twice(i)).otherwise(digit(i)))
        return F.when(F.length(digits).between(16, 19), total % 10 == 0).otherwise(False)
    return F.length(digits).between(8, 15)


def _valid_span(kind: str):
    return lambda x: _valid(kind, x["m"])


def base_spans(docs: DataFrame, text: str = "text", prefix: str = "_pii_") -> DataFrame:
    """docs with one column of spans for each kind, named prefix + kind."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    needs = {"email": "@", "phone": "+"}
    found = {}
    for k in KINDS:
        every = F.regexp_extract_all(t, F.lit(PATTERNS[k]), F.lit(0))
        if k == "card":
            every = F.filter(every, lambda m: F.length(m) > 1)
        found[prefix + k] = F.when(F.contains(t, F.lit(needs[k])), every).otherwise(F.array().cast("array<string>")) if k in needs else every
    out = docs.withColumns(found)
    spans = {prefix + k: _located(t, F.col(prefix + k), F.lit(PATTERNS[k]), k) for k in KINDS}
    out = out.withColumns(spans)
    return out.withColumns({prefix + k: F.filter(prefix + k, _valid_span(k)) for k in KINDS if k != "email"})


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


#: Characters of a text's pieces from which spans are cut, so that a cut costs a piece at most.
PIECE = 2048


def replaced(text: Column, spans: Column, by) -> Column:
    """text with its spans, overlapping ones together, replaced by by(kind)."""
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["kind"].alias("kind"))))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    at = lambda x: F.floor(x / PIECE).cast("int")

    def whole(t: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:
            some = F.array_join(F.slice(t["pieces"], at(a) + 1, at(b - 1) - at(a) + 1), "")
            return F.when(b > a, F.substring(some, (a % PIECE + 1).cast("int"), (b - a).cast("int"))).otherwise("")

        before = F.concat(F.array(F.lit(0).cast("bigint")), t["reach"])
        heads = F.filter(F.arrays_zip(t["order"].alias("x"), before.alias("before")), lambda p: p["x"].isNotNull() & (p["x"]["s"] >= p["before"]))
        body = F.transform(heads, lambda p: F.concat(cut(p["before"], p["x"]["s"]), by(p["x"]["kind"])))
        return F.concat(F.array_join(body, ""), cut(F.element_at(t["reach"], -1), t["n"]))

    reach = lambda o: running(F.transform(o, lambda x: -x["e"]), lambda a, b: F.greatest(a, b))
    laid = lambda o: F.struct(pieces.alias("pieces"), o.alias("order"), reach(o).alias("reach"), F.length(text).cast("bigint").alias("n"))
    return F.when(F.size(spans) > 0, let(let(order, laid), whole)).otherwise(text)


def lowered(text: Column) -> Column:
    """Lower-case with as many characters as before: of all, only the dotted capital I would become two."""
    return F.translate(F.lower(F.translate(text, "\u0130", "i")), "\u03c2", "\u03c3")


def terms(text: Column) -> Column:
    """The different terms of a text."""
    return F.filter(F.array_distinct(F.split(lowered(text), r"[^\p{L}\p{N}]+")), lambda w: F.length(w) > 0)


def _is_in(words: Column, of: Column) -> Column:
    """Those of `words`, spans with text m, of which m is in the array `of`; by hash groups, as many as the root of its size."""
    def picked(t: Column) -> Column:
        return F.filter(t["words"], lambda x: F.array_contains(F.get(t["groups"], F.pmod(F.hash(x["m"]), F.size(t["groups"]))), x["m"]))

    n = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(of))).cast("int"))
    groups = F.transform(F.sequence(F.lit(0), n - 1), lambda g: F.filter(of, lambda t: F.pmod(F.hash(t), n) == g))
    return let(F.struct(words.alias("words"), groups.alias("groups")), picked)


def evidence(spans: Column, support: int) -> Column:
    """Items (m, entity, whole) of one document's spans of one kind: its different entities, and their set.

    A single entity is its own set; otherwise one more item, which no entity equals, stands for all of them.
    `support` entities of a document are enough: if it holds more, any `support` of them show that
    there are as many, and if not, all are here; so the comparison with `support` is exact.
    """
    every = F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["m"])))
    item = lambda m, entity, whole: F.struct(m.alias("m"), F.lit(entity).alias("entity"), F.lit(whole).alias("whole"))
    several = F.concat(F.transform(F.slice(every, 1, support), lambda m: item(m, 1, 0)), F.array(item(F.concat(F.lit("\n"), F.sha2(F.array_join(every, "\n"), 256)), 0, 1)))
    return F.when(F.size(every) == 1, F.transform(every, lambda m: item(m, 1, 1))).otherwise(several)


def disclosing_terms(n: int, docs: DataFrame, held: DataFrame, text: str, generalise: float, support: int) -> DataFrame:
    """(kind, term, share): terms that disclose at least `generalise` of a kind's information.

    docs: the texts of all `n` documents; held: for each document with an entity its masked text and
    `reps`, one (kind, items) for each kind that it holds (see `evidence`).
    """
    n = F.lit(n)
    of_kind = held.select(F.explode("reps").alias("r")).groupBy(F.col("r.kind").alias("kind")).agg(F.count("*").alias("n_k"))
    pairs = held.select(F.explode(terms(F.col("masked"))).alias("term"), "reps").select("term", F.explode("reps").alias("r")).select("term", F.col("r.kind").alias("kind"), F.explode("r.items").alias("i"))
    pairs = pairs.groupBy("term", "kind", F.col("i.m").alias("m")).agg(F.max("i.entity").alias("entity"), F.max("i.whole").alias("whole"), F.sum("i.whole").alias("c"))
    pairs = pairs.groupBy("term", "kind").agg(F.sum("entity").alias("entities"), F.sum("whole").alias("sets"), F.sum("c").alias("n_tk")).where(F.least("entities", "sets") >= support)
    of_term = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    got = of_term.join(pairs.hint("merge"), "term").join(F.broadcast(of_kind), "kind")
    pmi = F.log2(F.col("n_tk") * n / (F.col("n_t") * F.col("n_k")))
    share = F.try_divide(pmi, F.log2(n / F.col("n_k")))
    return got.select("kind", "term", share.alias("share")).where(F.col("share") >= generalise)


def detected(docs: DataFrame, text: str = "text", generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT) -> tuple[DataFrame, str, str]:
    """docs with two more columns of spans, the base ones and those that the method adds, and these columns' names."""
    work: list[str] = []
    base_name, added_name = free_name(docs, "_base"), free_name(docs, "_added")
    src = docs.select(F.struct(*docs.columns).alias("_k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = base_spans(src).select("_k.*", F.concat(*[F.col(f"_pii_{k}") for k in KINDS]).alias(base_name))
    rows = Numbered(found, "pii-rows")
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    held = rows.df.where(F.size(base_name) > 0).select(F.col(rows.row).alias("row"), plain.alias("text"), F.col(base_name).alias("base"))
    of = lambda k: F.filter("base", lambda x: x["kind"] == k)
    rep = lambda k: F.when(F.size(of(k)) > 0, F.struct(F.lit(k).alias("kind"), evidence(of(k), support).alias("items")))
    masked = replaced(F.col("text"), F.col("base"), lambda kind: F.lit(" ")).alias("masked")
    reps = held.select(masked, F.array_compact(F.array(*[rep(k) for k in KINDS])).alias("reps"))
    telling = written(disclosing_terms(rows.df.count(), rows.df.select(plain.alias("text")), reps, "text", generalise, support), "disclosing-terms", work)
    size = telling.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    mine = held.select("row", F.array_distinct("base.kind").alias("kinds"), F.explode(terms(masked)).alias("term")).select("row", "term", F.explode("kinds").alias("kind"))
    mine = mine.join(telling.hint("broadcast" if size <= BROADCAST_BYTES else "merge"), ["term", "kind"]).groupBy("row", "term").agg(F.max("share").alias("share"))
    word = lambda over: F.collect_set(F.when(over, F.col("term")))
    mine = mine.groupBy("row").agg(F.struct(word(F.col("share") < remove).alias("soft"), word(F.col("share") >= remove).alias("hard")).alias("words"))
    words = free_name(rows.df, "_words")
    mine = written(mine.select(F.col("row").alias(rows.row), F.col("words").alias(words)), "terms-by-row")
    discard(docs.sparkSession, work)
    out = rows.joined(mine, words)
    low, token = lowered(plain), F.lit(r"[\p{L}\p{N}]+")

    def spans(kind: str, w: str) -> Column:
        of = F.col(words)[w]
        some = F.coalesce(F.size(of), F.lit(0)) > 0
        return F.when(some, _is_in(_located(low, F.regexp_extract_all(low, token, F.lit(0)), token, kind), of)).otherwise(F.array().cast(SPAN))

    added = F.concat(spans("generalised", "soft"), spans("removed", "hard"))
    out = out.withColumn(added_name, F.filter(added, lambda x: ~F.exists(base_name, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))))
    return out.select(*docs.columns, base_name, added_name), base_name, added_name


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, digest of the base spans and all spans."""
    got, base, added = detected(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return got.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col(base)), 256).alias("base_sha256"), joined(F.concat(base, added)).alias("spans"))


def sanitised(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data and disclosing terms replaced in `text`; other rows and columns as they are."""
    got, base, added = detected(docs, text)
    by = lambda kind: F.when(kind == "removed", "").when(kind == "generalised", "[TERM]").otherwise(F.concat(F.lit("["), F.upper(kind), F.lit("]")))
    every = F.concat(base, added)
    new = F.when(F.size(every) > 0, replaced(F.col(text).cast("string"), every, by)).otherwise(F.col(text))
    return got.select(*[new.alias(c) if c == text else F.col(c) for c in docs.columns])
