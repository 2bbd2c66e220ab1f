"""Operator 1: language identification by Bayesian evidence fusion.

For each page and language l the log posterior adds up

- the text: mean log likelihood of its hashed byte trigrams, times at most `EVIDENCE` of them
  (trigrams overlap, so a long text must not drown all else);
- the declared markup language d: log P(d | l);
- the address suffix s: log P(s | l);
- the host prior: counts of languages on the host's other pages, smoothed towards the
  site's other hosts, in turn smoothed towards all pages, each with a weight of `WEIGHT`.

P(d | l), P(s | l) and the priors come from grouped aggregations of soft counts: each page
gives its text posterior (under equal priors), so no declaration is trusted blindly. A
page's own soft count is taken out of its host prior, and a host's out of its site's.

The trigram model is trained on at most about `max_train` labelled documents, chosen by a
hash of the id; its size is languages x 2**15. Counts by host are combined before the
shuffle; pages meet their host's row in a join with one row for each host, which adaptive
execution splits for a hot host. Everything but the trigram sums is native.

Nulls and rows: a null or empty html has no text evidence; a null url has a null host, whose
pages share the prior of all pages; a missing declaration is a value of its own; repeated
pages are each returned; ties go to the first language by name; an empty table gives an
empty result, as does an empty training set; further columns are ignored; a page of any length is
read to its end in blocks and gives one row. The model holds at most MAX_LANGS languages (128 KB each);
a table with more raises.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, written

BITS = 15
MAX_TRAIN = 4_000
#: Languages of a model, which has a row for each.
MAX_LANGS = 2_048
EVIDENCE = 40.0
WEIGHT = 5.0
_TAGS = re.compile(r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*(?:>|\Z)")


def page_text(html: str | None) -> str:
    return html_lib.unescape(_TAGS.sub(" ", html or ""))


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of a lower-cased text with single spaces."""
    raw = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode(), dtype=np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, dtype=np.int64)
    h = raw[:-2] * np.uint32(0x9E3779B1) ^ raw[1:-1] * np.uint32(0x85EBCA6B) ^ raw[2:] * np.uint32(0xC2B2AE35)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


def train(docs: DataFrame, max_train: int = MAX_TRAIN, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """Languages by name and their log likelihoods (language x trigram)."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(F.lit("langid"), doc_id, text).alias("h"))
    # Languages come from all rows and each is sampled at a rate of its own, so a rare one is learnt at any size.
    sizes = known.groupBy("l").agg(F.count("*").alias("n"))
    names = sizes.count()
    if names > MAX_LANGS:
        raise ValueError(f"{names} languages; a model holds {MAX_LANGS}")
    each = max(1, max_train // max(1, names))
    sample = known.join(F.broadcast(sizes), "l").where(F.pmod("h", F.lit(1 << 40)) < F.least(F.lit(1.0), each / F.col("n")) * float(1 << 40))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total.setdefault(name, np.zeros(1 << BITS, dtype=np.int64))
                total[name] += np.bincount(trigrams(t), minlength=1 << BITS)
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(n[at])], ["lang", "at", "n"])

    rows = sample.select("l", "t").mapInArrow(run, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    count = np.full((len(langs), 1 << BITS), 0.5)
    if langs:
        count[np.searchsorted(langs, rows["lang"]), rows["at"]] += rows["n"]
    return langs, np.log(count / count.sum(axis=1, keepdims=True)).astype(np.float32)


def host_of(url: Column) -> Column:
    host = F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), r"^[^@]*@|:[0-9]+$", "")
    return F.when(host != "", host)


def evidence(pages: DataFrame, langs: list[str], weights: np.ndarray, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """page_id, host, site, suffix, declared and ll (text log likelihood by language)."""
    sent = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for b in batches:
            rows = []
            for _, texts in slices(b.column(b.num_columns - 1)):
                for t in texts:
                    at = trigrams(page_text(t))
                    rows.append((w[:, at].mean(axis=1, dtype=np.float64) * min(float(len(at)), EVIDENCE)).tolist() if len(at) else [0.0] * len(langs))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, pa.list_(pa.float64()))], [*b.schema.names[:-1], "ll"])

    host = host_of(F.col(url))
    part = F.split(F.col("host"), r"\.")
    declared = F.regexp_extract(F.col(html).cast("string"), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)
    src = pages.select(F.col(page_id).cast("long").alias("page_id"), host.alias("host"), F.coalesce(F.when(declared != "", F.lower(declared)), F.lit("")).alias("declared"), F.col(html).cast("string").alias("_html"))
    src = src.select("page_id", "host", F.concat_ws(".", F.slice(part, F.greatest(F.size(part) - 1, F.lit(1)), F.lit(2))).alias("site"), F.coalesce(F.element_at(part, -1), F.lit("")).alias("suffix"), "declared", "_html")
    return src.mapInArrow(run, "page_id long, host string, site string, suffix string, declared string, ll array<double>")


def identified(pages: DataFrame, docs: DataFrame, max_train: int = MAX_TRAIN, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """page_id, host, declared, text_lang, lang and probability of every page."""
    langs, weights = train(docs, max_train)
    k = len(langs)
    if not k:
        return pages.where(F.lit(False)).select(F.col(page_id).cast("long").alias("page_id"), *[F.lit("").alias(c) for c in ("host", "declared", "text_lang", "lang")], F.lit(0.0).alias("probability"))
    got = evidence(pages, langs, weights, html, url, page_id)
    softmax = lambda c: F.transform(c, lambda x: F.exp(x - F.array_max(c)) / F.aggregate(c, F.lit(0.0), lambda a, y: a + F.exp(y - F.array_max(c))))
    got = written(got.withColumn("p", softmax(F.col("ll"))), "page-evidence")
    sums = lambda d: d.agg(*[F.sum(F.col("p")[i]).alias(f"c{i}") for i in range(k)])
    every = sums(got.groupBy()).first()
    mass = [float(every[f"c{i}"] or 0.0) + 1.0 for i in range(k)]
    top = F.array(*[F.lit(m / sum(mass)) for m in mass])

    def given_lang(column: str, name: str) -> DataFrame:
        """log P(value | language) for each value of a column, by language."""
        counts = sums(got.groupBy(column))
        n = F.lit(counts.count() + 1.0)
        return counts.select(F.col(column).alias(f"_{name}"), F.array(*[F.log((F.col(f"c{i}") + 0.5) / (F.lit(mass[i] - 1.0) + 0.5 * n)) for i in range(k)]).alias(name))

    hosts = sums(got.where("host is not null").groupBy("site", "host"))
    sites = sums(hosts.select("site", F.array(*[F.col(f"c{i}") for i in range(k)]).alias("p")).groupBy("site")).select("site", F.array(*[F.col(f"c{i}") for i in range(k)]).alias("of_site"))
    hosts = hosts.select("site", "host", F.array(*[F.col(f"c{i}") for i in range(k)]).alias("of_host")).join(sites, "site")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    smoothed = lambda counts, prior: F.transform(F.zip_with(counts, prior, lambda c, q: F.greatest(c, F.lit(0.0)) + WEIGHT * q), lambda x: x / (F.greatest(total(counts), F.lit(0.0)) + WEIGHT))
    others = F.zip_with("of_site", "of_host", lambda a, b: a - b)
    hosts = hosts.select(F.col("host").alias("_host"), "of_host", smoothed(others, top).alias("above"))
    out = got.join(hosts, got.host == hosts["_host"], "left")
    for column, name in (("declared", "by_declared"), ("suffix", "by_suffix")):
        table = given_lang(column, name)
        out = out.join(table, out[column] == table[f"_{name}"])
    own = F.zip_with("of_host", "p", lambda a, b: a - b)
    prior = F.coalesce(smoothed(own, F.col("above")), top)
    add = lambda *cs: F.array(*[sum((c[i] for c in cs[1:]), cs[0][i]) for i in range(k)])
    out = out.withColumn("prior", prior)
    out = out.withColumn("posterior", softmax(add(F.col("ll"), F.transform("prior", lambda x: F.log(x)), F.col("by_declared"), F.col("by_suffix"))))
    name = F.array(*[F.lit(x) for x in langs])
    first = lambda c: F.element_at(name, F.array_position(c, F.array_max(c)).cast("int"))
    return out.select("page_id", "host", "declared", first(F.col("p")).alias("text_lang"), first(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("probability"))
