"""Quality rules: decision lists learned from labelled statistics.

`text_statistics` counts what a text is made of; `learn_rules` covers the
labelled rejects one conjunction of thresholds after another (grow on one part
of the rows, prune on the rest); `verdict` turns the ordered list into one
conditional expression that Spark evaluates beside the statistics.

Nulls and empty texts count as zero words. Without labelled rows of both
classes the list is empty and keeps everything.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomaudit.llm.common import bounded_sample

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_distinct_words")
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
WINDOW = 5
#: Rows that the rules are learned from, at most.
SAMPLE_ROWS = 20_000


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more, the first find included."""
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    seen, covered, end = Counter(grams), 0, 0
    for at, gram in enumerate(grams):
        if seen[gram] > 1:
            covered += at + window - max(at, end)
            end = at + window
    return covered


def count_text(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text."""
    if not text:
        return (0,) * len(COUNTS)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(map(bytes.isupper, words)),
        len(set(words)),
    )


STATISTICS = "struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ">"


def _statistics(text: pa.Array) -> pa.Array:
    table = np.array([count_text(x.as_py()) for x in text], dtype=np.int64).reshape(-1, len(COUNTS))
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(table[:, i])) for i in range(len(COUNTS))], list(COUNTS))


def text_statistics(text: Column) -> Column:
    """The COUNTS of every text, as a struct."""
    return F.arrow_udf(_statistics, STATISTICS)(text)


def features(s: Column) -> dict[str, Column]:
    """The ratios that rules may test, from a statistics struct."""
    words, chars, lines = (F.greatest(s[c], F.lit(1)).cast("double") for c in ("n_words", "word_chars", "n_lines"))
    return {
        "n_words": s["n_words"].cast("double"),
        "symbol_share": s["n_symbols"] / chars,
        "word_length": s["word_chars"] / words,
        "upper_share": s["n_upper_words"] / words,
        "duplicate_line_share": s["n_dup_lines"] / lines,
        "repeat_share": s["n_repeat_words"] / words,
        "distinct_share": s["n_distinct_words"] / words,
    }


def base_failed(s: Column) -> Column:
    """Too short (fewer than 10 words), or over a fifth of the words repeat."""
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, is at least, threshold) that rejects; precision and support were measured on the pruning rows."""

    tests: tuple[tuple[str, bool, float], ...]
    precision: float
    support: int


def _covers(tests, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), dtype=bool)
    for name, at_least, threshold in tests:
        out &= (x[name] >= threshold) if at_least else (x[name] < threshold)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most_tests: int) -> list[tuple[str, bool, float]]:
    """Adds the test of the largest FOIL gain until no good row is covered or nothing is gained."""
    tests: list[tuple[str, bool, float]] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(tests) < most_tests and (inside & ~bad).any():
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        best, test = 1e-9, None
        for name in sorted(x):
            values = x[name][inside]
            for threshold in np.unique(np.quantile(values, np.linspace(0.005, 0.995, 100))):
                up = values >= threshold
                for at_least, side in ((True, up), (False, ~up)):
                    p1 = (bad[inside] & side).sum()
                    n1 = side.sum() - p1
                    if p1 and (gain := p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))) > best:
                        best, test = gain, (name, at_least, float(threshold))
        if test is None:
            break
        tests.append(test)
        inside &= _covers([test], x)
    return tests


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 12, most_tests: int = 4, least_precision: float = 0.7, least_support: int = 5) -> list[Rule]:
    """Sequential covering. A third of the rows, dealt by position, prunes: a rule's last tests go while that does not lower (p - n) / (p + n) there."""
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    pruning = np.arange(len(bad)) % 3 == 2
    while len(rules) < most_rules and (bad & left & ~pruning).sum() >= least_support:
        take = left & ~pruning
        tests = _grow({k: v[take] for k, v in x.items()}, bad[take], most_tests)
        hold = left & pruning

        def worth(t, hold=hold) -> tuple[float, int]:
            hit = _covers(t, x) & hold
            return ((bad & hit).sum() / hit.sum() if hit.any() else 0.0), int(hit.sum())

        while len(tests) > 1 and worth(tests[:-1])[0] >= worth(tests)[0]:
            tests = tests[:-1]
        precision, support = worth(tests) if tests else (0.0, 0)
        if precision < least_precision or support < 2:
            break
        rules.append(Rule(tuple(tests), float(precision), support))
        left &= ~_covers(tests, x)
    return rules


def verdict(rules: list[Rule], named: dict[str, Column]) -> Column:
    """The ordered list as one conditional: true keeps; the first rule that holds rejects."""
    out = None
    for rule in rules:
        holds = F.lit(True)
        for name, at_least, threshold in rule.tests:
            holds &= (named[name] >= threshold) if at_least else (named[name] < threshold)
        out = F.when(holds, False) if out is None else out.when(holds, False)
    return F.lit(True) if out is None else out.otherwise(True)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules from the labelled documents, from at most sample_rows of them. A document labelled both ways counts as rejected; of rows that share an id the least statistics count."""
    judged = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    sample = F.broadcast(bounded_sample(judged, "doc_id", sample_rows))
    named = docs.select("doc_id", "text").join(sample, "doc_id").select("doc_id", "_quality", text_statistics(F.col("text")).alias("_s"))
    single = named.groupBy("doc_id").agg(F.min("_quality").alias("_quality"), F.min("_s").alias("_s")).where(~base_failed(F.col("_s")))
    rows = single.select("_quality", "doc_id", *(c.alias(k) for k, c in features(F.col("_s")).items())).collect()
    if not rows:
        return []
    rows.sort(key=lambda r: (r["doc_id"], tuple(r)))
    names = [c for c in rows[0].asDict() if c not in ("_quality", "doc_id")]
    table = np.array([[r[c] for c in names] for r in rows], dtype=float)
    return learn_rules({c: table[:, i] for i, c in enumerate(names)}, np.array([r["_quality"] == 0 for r in rows]))


def judged(docs: DataFrame, rules: list[Rule], statistics: str = "statistics", failed: str = "base_failed", kept: str = "kept", text: str = "text") -> DataFrame:
    """docs with the statistics struct, whether a base rule failed, and the verdict, in columns of these names; columns of docs that have them are replaced (`common.fresh` finds names that are free)."""
    with_counts = docs.withColumn(statistics, text_statistics(F.col(text)))
    s = F.col(statistics)
    return with_counts.withColumn(failed, base_failed(s)).withColumn(kept, ~F.col(failed) & verdict(rules, features(s)))
