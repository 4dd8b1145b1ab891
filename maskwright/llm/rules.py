"""Quality rules: a decision list learned by sequential covering from labelled text statistics.

Rules are conjunctions of thresholds, each grown on one part of the labelled rows and pruned on the
other. The list is emitted as one ordered conditional expression over the statistics, so judging a
document needs no Python beyond the counting of its words.

Defined results: a null or empty text has no words, every count is 0, and it fails the base rule.
Repeated rows are judged one by one. Empty tables give empty results, and without usable labels the
list is empty, so only the base rule rejects. Columns of the input are kept as they are.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.common import column

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_bangs", "n_distinct"]
# The symbols that count, and the limits of the base rule.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_UPPER, _DIGITS, _BLANK = bytes(range(65, 91)), bytes(range(48, 58)), b" \t\n\v\f\r"


def count_text(text: bytes) -> tuple[int, ...]:
    """The statistics of one UTF-8 text, in the order of COUNTS."""
    words = text.split()  # on the six ASCII white-space characters, as bytes.split does
    n = len(words)
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    repeated = 0
    if len(times) < len(windows):
        end = 0  # windows that repeat may overlap: each word counts once
        for at, window in enumerate(windows):
            if times[window] > 1:
                repeated += at + 3 - max(end, at)
                end = at + 3
    seen: set[bytes] = set()
    doubled = 0
    if b"\n" in text:
        for line in text.split(b"\n"):
            if line in seen:
                doubled += bool(line.strip(_BLANK))
            else:
                seen.add(line)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    size = len(joined)
    without = lambda drop: size - len(joined.translate(None, drop))
    return n, chars, without(SYMBOLS), doubled, repeated, without(_UPPER), without(_DIGITS), joined.count(b"!"), len(set(words))


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def _count(texts: pa.Array) -> pa.Array:
    rows = [count_text(t or b"") for t in texts.to_pylist()]
    columns = np.array(rows, np.int64).reshape(-1, len(COUNTS)).T
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], COUNTS)


def statistics(text: Column) -> Column:
    """Struct of the counts of a text; all of them are 0 for null."""
    return _count(text.cast("binary"))


# name -> (numerator, denominator); ratios to which the thresholds apply
RATIOS = {
    "symbols_per_char": ("n_symbols", "word_chars"),
    "capitals_per_char": ("n_upper", "word_chars"),
    "digits_per_char": ("n_digits", "word_chars"),
    "bangs_per_word": ("n_bangs", "n_words"),
    "repeats_per_word": ("n_repeat_words", "n_words"),
    "distinct_per_word": ("n_distinct", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "dup_lines_per_word": ("n_dup_lines", "n_words"),
}


@dataclass(frozen=True)
class Test:
    """``ratio >= limit`` or ``ratio <= limit``."""

    ratio: str
    above: bool
    limit: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        v = values[self.ratio]
        return v >= self.limit if self.above else v <= self.limit

    def expression(self, stats: Column) -> Column:
        over, under = RATIOS[self.ratio]
        ratio = stats[over] / F.greatest(stats[under], F.lit(1))
        return ratio >= self.limit if self.above else ratio <= self.limit


Rule = tuple[Test, ...]


def _covers(rule: Rule, values: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(values.values()))), bool)
    for test in rule:
        out &= test.holds(values)
    return out


def _grow(values: dict[str, np.ndarray], bad: np.ndarray, limits: list[Test], most: int) -> Rule:
    """Add the test with the largest information gain until only bad rows are covered."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    held = [(t, t.holds(values)) for t in limits]
    while len(rule) < most:
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        if p == 0 or n == 0:
            break
        before, best, gain = np.log2(p / (p + n)), None, 1e-9
        for test, mask in held:
            p1, n1 = (inside & mask & bad).sum(), (inside & mask & ~bad).sum()
            if p1 and (g := p1 * (np.log2(p1 / (p1 + n1)) - before)) > gain:
                best, gain = (test, mask), g
        if best is None:
            break
        rule += (best[0],)
        inside = inside & best[1]
    return rule


def _prune(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drop last tests while that raises the worth on rows the rule has not been grown on."""

    def worth(r: Rule) -> float:
        c = _covers(r, values)
        p, n = (c & bad).sum(), (c & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)


def learn(rows: np.ndarray, bad: np.ndarray, least_precision: float = 0.95, max_rules: int = 12, max_tests: int = 4) -> list[Rule]:
    """Ordered rules for rejecting. ``rows`` holds COUNTS by column; every third row is for pruning only."""
    at = {c: i for i, c in enumerate(COUNTS)}
    values = {k: rows[:, at[a]] / np.maximum(rows[:, at[b]], 1) for k, (a, b) in RATIOS.items()} if len(rows) else {}
    rules: list[Rule] = []
    pruning = np.arange(len(rows)) % 3 == 2
    left = np.ones(len(rows), bool)
    while len(rules) < max_rules:
        grow, prune = left & ~pruning, left & pruning
        if not (grow & bad).any() or not (grow & ~bad).any() or not (prune & bad).any():
            break
        part = {k: v[grow] for k, v in values.items()}
        # limits lie between the values of bad rows and others, so that both sides keep a margin
        limits = []
        for k, v in part.items():
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, 65)))
            limits += [Test(k, above, round(float(c), 6)) for c in (cuts[1:] + cuts[:-1]) / 2 for above in (True, False)]
        rule = _grow(part, bad[grow], limits, max_tests)
        if not rule:
            break
        checked = {k: v[prune] for k, v in values.items()}
        rule = _prune(rule, checked, bad[prune])
        covered = _covers(rule, checked)
        p, n = (covered & bad[prune]).sum(), (covered & ~bad[prune]).sum()
        if p == 0 or p / (p + n) < least_precision:
            break
        rules.append(rule)
        left &= ~_covers(rule, values)
    return rules


def rejected(stats: Column, rules: list[Rule]) -> Column:
    """The list as one conditional expression: number of the first rule that holds, else null."""
    out = None
    for i, rule in enumerate(rules):
        condition = F.lit(True)
        for test in rule:
            condition = condition & test.expression(stats)
        out = F.when(condition, F.lit(i)) if out is None else out.when(condition, F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", sample: int = 8000) -> list[Rule]:
    """Learn from at most ``sample`` labelled documents, chosen by the hash of their ids.

    Contradictory labels of one document count as bad. Only the chosen documents are counted, and
    only their counts reach the driver.
    """
    known = labels.select(column(labels, doc_id).alias("id"), column(labels, quality).alias("q")).where("id IS NOT NULL AND q IN (0, 1)")
    chosen = known.groupBy("id").agg(F.min("q").alias("q")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(column(docs, doc_id).alias("id"), column(docs, text).alias("t"))
    # at most `sample` small rows, so a broadcast is safe
    counted = texts.join(F.broadcast(chosen), "id").select("id", "q", statistics(F.col("t")).alias("s"))
    got = counted.select("id", "q", "s.*").orderBy(F.xxhash64("id"), *COUNTS).limit(sample).collect()
    # what the base rule rejects is no example; this is left to the driver, since as a filter it
    # would be pushed below the join and count the words of every document
    rows = [r for r in got if r["n_words"] >= MIN_WORDS and 100 * r["n_repeat_words"] <= MAX_REPEAT_PERCENT * r["n_words"]]
    return learn(np.array([[r[c] for c in COUNTS] for r in rows], np.float64).reshape(-1, len(COUNTS)), np.array([r["q"] == 0 for r in rows], bool))


def judge(docs: DataFrame, rules: list[Rule], text: str = "text", into: str = "quality_rules") -> DataFrame:
    """``docs`` and a struct column ``into``: the counts, base_failed, rule (number or null) and kept."""
    out = docs.withColumn(into, statistics(column(docs, text)))
    s = F.col(into)
    fails, rule = base_failed(s), rejected(s, rules)
    return out.withColumn(
        into,
        F.struct(*(s[c].alias(c) for c in COUNTS), fails.alias("base_failed"), rule.alias("rule"), (~fails & rule.isNull()).alias("kept")),
    )
