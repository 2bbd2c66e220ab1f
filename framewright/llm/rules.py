"""Operator 6: quality rules as a learned decision list.

Text statistics of every document come first, with the fixed base rule. Labelled
statistics then train an ordered list of rules by sequential covering: a rule grows one
threshold condition at a time by information gain on two thirds of the rows, is pruned from
its end by its precision on the last third, and the rows it covers are set aside before
the next rule is sought. The list is emitted as one Spark CASE expression.

Learning uses at most about `max_train` labelled rows, chosen by a hash of the id; the
statistics and the verdicts cover all documents.

Nulls and rows: a null text has no words; null ids and repeated rows are each returned; an
id labelled repeatedly counts with its mean label, null labels not at all; without labels
the list is empty and the base rule alone decides; of equal gains the first statistic and lower threshold win; an
empty table gives an empty result;
further columns are ignored; texts over a megabyte are counted by 64-bit hashes of their words
and lines, in bounded memory.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, SPACES, WordHasher, mix, slices, written

SYMBOLS = b"#*$%&|<>"
MAX_TRAIN = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_distinct", "n_marks", "longest_word")
_words = WordHasher(SPACES)
_UPPER, _DIGITS, _MARKS = bytes(range(65, 91)), bytes(range(48, 58)), b".,;:!?"


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that stand twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def statistics(text: str | None) -> tuple[int, ...]:
    """The COUNTS of one text."""
    data = (text or "").encode()
    if len(data) > BLOCK:
        return _long_statistics(data, len(text))
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    without = lambda chars: len(data) - len(data.translate(None, chars))
    return (
        len(words),
        len(text or "") - without(SPACES),
        without(SYMBOLS),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        without(_UPPER),
        without(_DIGITS),
        len(set(words)),
        without(_MARKS),
        max(map(len, words), default=0),
    )


def _lines(data: bytes) -> Iterator[int]:
    """A 64-bit hash of every line with a word."""
    at = 0
    while at <= len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        if line := data[at:end]:
            if line.strip():
                yield xxhash.xxh3_64_intdigest(line)
        at = end + 1


def _long_statistics(data: bytes, n_chars: int) -> tuple[int, ...]:
    """The COUNTS of a long text, from hashes of its words and lines: some 50 bytes for each word."""
    without = lambda chars: sum(len(b) - len(b.translate(None, chars)) for b in (data[at : at + BLOCK] for at in range(0, len(data), BLOCK)))
    parts, longest = [np.zeros(0, dtype=np.uint64)], 0
    for block in _words.cut(data):
        words = block.split()
        longest = max(longest, max(map(len, words), default=0))
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)))
    h = np.concatenate(parts)
    parts.clear()
    n, distinct, covered = len(h), len(np.unique(h)), np.zeros(len(h), dtype=bool)
    if n > 2:
        h = mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:])
        value, times = np.unique(h, return_counts=True)
        twice = np.isin(h, value[times > 1])
        for k in range(3):
            covered[k : n - 2 + k] |= twice
    lines = np.fromiter(_lines(data), dtype=np.uint64)
    return (n, n_chars - without(SPACES), without(SYMBOLS), len(lines) - len(np.unique(lines)), int(covered.sum()), len(lines), without(_UPPER), without(_DIGITS), distinct, without(_MARKS), longest)


def with_statistics(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for _, texts in slices(b.column(1)):
                rows += [statistics(t) for t in texts]
            cols = np.array(rows, dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(cols[:, i]) for i in range(len(COUNTS)))], ["doc_id", *COUNTS])

    kinds = ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id long, {kinds}")


def measures() -> dict[str, Column]:
    """What rules may test: counts and their ratios."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    out = {"n_words": F.col("n_words").cast("double"), "longest_word": F.col("longest_word").cast("double")}
    pairs = {"word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "line_words": ("n_words", "n_lines"), "upper": ("n_upper", "word_chars"), "digits": ("n_digits", "word_chars"), "distinct": ("n_distinct", "n_words"), "marks": ("n_marks", "n_words")}
    return out | {k: ratio(*v) for k, v in pairs.items()}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    value: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] >= self.value if self.above else x[self.name] < self.value

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.name] >= self.value if self.above else of[self.name] < self.value


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    """Adds the condition with the largest FOIL gain until no good row is covered."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < most and (inside & ~bad).any():
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        best, gain = None, 1e-9
        before = np.log2(p / (p + n)) if p else 0.0
        for name in sorted(x):
            v = x[name][inside]
            cuts = np.unique(np.quantile(v[bad[inside]], np.linspace(0, 1, 41))) if p else []
            for cut in cuts:
                for above in (True, False):
                    hit = v >= cut if above else v < cut
                    hp = int((hit & bad[inside]).sum())
                    hn = int(hit.sum()) - hp
                    if hp and (g := hp * (np.log2(hp / (hp + hn)) - before)) > gain:
                        best, gain = Condition(name, above, float(cut)), g
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return tuple(rule)


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The prefix with the largest (bad - good) / covered; the shorter among equals."""
    best, worth = rule, -2.0
    for k in range(1, len(rule) + 1):
        hit = covers(rule[:k], x)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        if p + n and (p - n) / (p + n) > worth + 1e-12:
            best, worth = rule[:k], (p - n) / (p + n)
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, precision: float = 0.9, most_rules: int = 24, most_conditions: int = 5) -> list[Rule]:
    """An ordered list of rules for the bad rows; fold 2 (of 0, 1, 2) prunes."""
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    while len(rules) < most_rules:
        grow, check = left & (fold != 2), left & (fold == 2)
        if (grow & bad).sum() < 3:
            break
        part = lambda m: ({k: v[m] for k, v in x.items()}, bad[m])
        rule = _grow(*part(grow), most_conditions)
        if not rule:
            break
        if (check & bad).any():
            rule = _prune(rule, *part(check))
        hit = covers(rule, x) & left
        if not hit.any() or (hit & bad).sum() < precision * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def as_column(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1, else null."""
    of, out = measures(), None
    for i, rule in enumerate(rules, 1):
        cond = rule[0].column(of)
        for c in rule[1:]:
            cond = cond & c.column(of)
        out = F.when(cond, i) if out is None else out.when(cond, i)
    return F.lit(None).cast("int") if out is None else out.cast("int")


def train(stats: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN) -> list[Rule]:
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(label).cast("double").alias("y"))
    share = min(1.0, max_train / max(known.count(), 1))
    known = known.where(F.pmod(F.xxhash64(F.lit("rules"), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    of = measures()
    rows = stats.where(~base_failed()).join(F.broadcast(known), "doc_id").select("doc_id", "y", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(3)).alias("fold"), *[c.alias(k) for k, c in of.items()])
    rows = sorted(set(map(tuple, rows.collect())))
    if not rows:
        return []
    cols = list(zip(*rows, strict=True))
    return learn({k: np.array(cols[3 + i]) for i, k in enumerate(of)}, np.array(cols[1]) < 0.5, np.array(cols[2]))


def judged(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, counts, base_failed, kept and the rule that rejects (null: none)."""
    stats = written(with_statistics(docs, text, doc_id), "statistics")
    rule = as_column(train(stats, labels, label, max_train))
    out = stats.select("*", base_failed().alias("base_failed"), rule.alias("rule"))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
