"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text.

Folding decomposes compatible characters, lower-cases, drops marks and invisible
characters, makes white space one space, and maps homoglyphs and digit
substitutions to plain letters, one character for one, so that a hit's place is
known in the unfolded text too. Lexicon entries are word beginnings with a
weight; a longer word than STEM_LENGTHS is known by its first letters. A hit
counts where no letter stands before it in the unfolded text. Hits within an
exception phrase do not count. The weighted sum, alone and by length, goes
through a logistic curve.

Entries, exceptions and curve are learned from labelled rows. Entries are chosen
on one half of the texts and must hold on the other; exceptions are phrases of
an entry's word and a neighbour that clean texts use and toxic ones do not.

A null or empty text has no hits and gets the score of a text without hits. Of
rows that repeat a labelled id the least text counts; ties in odds fall to the
longer, then to the alphabetically first entry. Without labelled rows of both
classes the lexicon is empty and every text has the same low score.
"""

from __future__ import annotations

import math
import string
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomaudit.llm.common import bounded_sample, crc_bucket, written

#: Labelled rows that the lexicon and the curve are learned from, at most.
SAMPLE_ROWS = 12_000
STEM_LENGTHS = range(3, 13)
THRESHOLD = 0.3
#: Texts whose stems are counted at once.
ROWS = 32
HELD_OUT = 2
#: Standard errors by which an entry's odds are lowered before entries are compared.
CAUTION = 1.645
#: Phrases that excuse whatever the labelled rows say; more are learned from these.
KNOWN_EXCEPTIONS = ("trash can", "trash bag", "clown fish")
#: Uses of an entry that count in one text when its odds are learned.
MOST_USES = 8

_LOOKALIKES = {
    "a": "аαａ4@",
    "b": "ЬᏏｂ8",
    "c": "сϲｃ",
    "d": "ԁｄ",
    "e": "еεｅ3",
    "g": "ɡｇ9",
    "h": "һｈ",
    "i": "іιｉ1!ı",
    "j": "јｊ",
    "k": "κкｋ",
    "l": "ⅼｌ|",
    "m": "ｍм",
    "n": "ｎп",
    "o": "оοｏ0",
    "p": "рρｐ",
    "r": "ｒг",
    "s": "ѕｓ5$",
    "t": "ｔт7",
    "u": "υｕ",
    "v": "νｖѵ",
    "w": "ｗѡ",
    "x": "хχｘ",
    "y": "уｙγ",
    "z": "ｚ",
}
_FOLD = {ord(c): letter for letter, alike in _LOOKALIKES.items() for c in alike}
_INVISIBLE = dict.fromkeys((0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
_DROPPED = _INVISIBLE | {c: None for c in range(0x300, 0xFE30) if unicodedata.category(chr(c)) == "Mn"}


def plain(text: str) -> str:
    """Lower case, without marks and invisible characters, white space as one space."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_DROPPED)
    return " ".join(text.lower().split())


def lookalikes(base: str) -> str:
    """Lookalikes and digits of a plain text as the letters they stand for, one character for one."""
    return base.translate(_FOLD)


def fold(text: str) -> str:
    """A text as entries are matched on it."""
    return lookalikes(plain(text))


@dataclass(frozen=True)
class Lexicon:
    """Weights by folded word beginning, phrases that excuse hits inside them, and the curve (constant, weight of the sum, weight of the density)."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = KNOWN_EXCEPTIONS
    curve: tuple[float, float, float] = (-4.0, 1.0, 1.0)

    def key(self) -> tuple:
        return tuple(sorted(self.weights.items())), tuple(sorted(set(map(fold, self.exceptions))))


@lru_cache(maxsize=4)
def automaton(key: tuple) -> ahocorasick.Automaton:
    """The matcher of a lexicon: entries and phrases to (length, weight of the entry or None, whether it is a phrase)."""
    weights, exceptions = dict(key[0]), set(key[1])
    found = ahocorasick.Automaton()
    for x in weights.keys() | exceptions:
        if x:
            found.add_word(x, (len(x), weights.get(x), x in exceptions))
    if len(found):
        found.make_automaton()
    return found


def hits_in(text: str, found: ahocorasick.Automaton) -> tuple[str, list[tuple[int, float]]]:
    """The folded text and (place, weight) of its entries: those with no letter before them, outside exception phrases of whole words."""
    if not len(found):
        return "", []
    base = plain(text)
    folded = lookalikes(base)
    hits, excused = [], []
    for last, (length, weight, phrase) in found.iter(folded):
        start = last - length + 1
        if start and base[start - 1].isalpha():
            continue
        if weight is not None:
            hits.append((start, last, weight))
        if phrase and not base[last + 1 : last + 2].isalpha():
            excused.append((start, last))
    return folded, [(a, w) for a, b, w in hits if not any(x <= a and b <= y for x, y in excused)] if excused else [(a, w) for a, _, w in hits]


def weigh(text: str, found: ahocorasick.Automaton) -> float:
    """Sum of the weights of a text's hits."""
    return sum(w for _, w in hits_in(text, found)[1])


def shape(total: float, words: int) -> tuple[float, float]:
    """The curve's two inputs: the weighted sum, and by length."""
    return math.log1p(total), math.log1p(100 * total / (words + 20))


def words_of(folded: str) -> list[str]:
    """Runs of letters and digits."""
    return "".join(c if c.isalnum() else " " for c in folded).split()


def stems_of(text: str | None) -> Counter:
    """The word beginnings of a text, folded, and how often each starts a word."""
    out: Counter = Counter()
    for w, times in Counter(words_of(fold(text or ""))).items():
        for n in STEM_LENGTHS:
            if n > len(w):
                break
            out[w[:n]] += times
    return out


def phrases_of(text: str | None, found: ahocorasick.Automaton) -> Counter:
    """Each hit's word with the word before and with the word after, as they stand in the folded text."""
    folded, hits = hits_in(text or "", found)
    out: Counter = Counter()
    for at, _ in hits:
        end = folded.find(" ", at) if " " in folded[at:] else len(folded)
        before = folded.rfind(" ", 0, max(at - 1, 0)) + 1
        after = folded.find(" ", end + 1)
        out.update({folded[before:end].strip(_EDGES), folded[at : after if after >= 0 else len(folded)].strip(_EDGES)})
    return Counter({x: n for x, n in out.items() if x.count(" ") == 1})


_EDGES = string.punctuation + " "


_SIDES = ("clean_0", "toxic_0", "clean_1", "toxic_1")
_COUNTS = (*_SIDES, *(f"{c}_uses" for c in _SIDES))


def feature_counts(rows: DataFrame, of: Callable[[str | None], Counter]) -> DataFrame:
    """(feature, clean_0, toxic_0, clean_1, toxic_1, and the same with _uses): by half and label, the texts of rows (_toxic, text) that hold each feature, and how often they do, MOST_USES in a text at most. Counts are added up for a few texts at a time before they leave a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                counts: dict[str, int] = {}
                for flag, text in zip(part.column("_toxic").to_pylist(), part.column("text"), strict=True):
                    text = text.as_py()
                    side = 2 * (zlib.crc32((text or "").encode("utf-8", "surrogatepass")) & 1) + (flag == 1)
                    texts, one_use = 1 << 16 * side, 1 << 16 * (side + 4)
                    for x, uses in of(text).items():
                        counts[x] = counts.get(x, 0) + texts + one_use * min(uses, MOST_USES)
                # Eight counts of 16 bits in one integer: a batch of ROWS texts cannot fill one.
                table = np.frombuffer(b"".join(x.to_bytes(2 * len(_COUNTS), "little") for x in counts.values()), dtype="<u2").reshape(-1, len(_COUNTS)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"feature": pa.array(counts, pa.string())} | {c: pa.array(np.ascontiguousarray(table[:, i])) for i, c in enumerate(_COUNTS)})

    counted = rows.mapInArrow(run, "feature string, " + ", ".join(f"{c} bigint" for c in _COUNTS))
    return counted.groupBy("feature").agg(*(F.sum(c).alias(c) for c in _COUNTS))


def weighed(lexicon: Lexicon):
    """An expression builder: text to struct<total, words>."""
    key = lexicon.key()

    def measure(text: pa.Array) -> pa.Array:
        found = automaton(key)
        totals, words = [], []
        for x in text:
            x = x.as_py()
            totals.append(weigh(x, found) if x else 0.0)
            words.append(len(x.split()) if x else 0)
        return pa.StructArray.from_arrays([pa.array(totals, pa.float64()), pa.array(words, pa.int64())], ["total", "words"])

    return F.arrow_udf(measure, "struct<total: double, words: bigint>")


def _odds(toxic_uses: int, clean_uses: int, n_toxic: int, n_clean: int) -> float:
    """How much more often a toxic text uses a stem than a clean one does, as a logarithm."""
    return math.log((toxic_uses + 0.5) / (n_toxic + 1)) - math.log((clean_uses + 0.5) / (n_clean + 1))


def choose_stems(counts: list[tuple], totals: tuple[int, int, int, int], least_support: int, least_odds: float) -> dict[str, float]:
    """Entries from (stem, then as _COUNTS names them). On one half of the texts a stem needs least_support toxic texts and least_odds; on the other, half of both; on both together, least_odds after CAUTION. They are taken by those odds times the root of their toxic texts, and each bars its own beginnings and what begins with it."""
    sure: list[tuple[float, int, str, float]] = []
    for stem, b0, a0, b1, a1, v0, u0, v1, u1 in counts:
        if a0 < least_support or 2 * a1 < least_support or _odds(u0, v0, totals[1], totals[0]) < least_odds or 2 * _odds(u1, v1, totals[3], totals[2]) < least_odds:
            continue
        odds = _odds(u0 + u1, v0 + v1, totals[1] + totals[3], totals[0] + totals[2])
        cautious = odds - CAUTION * math.sqrt(1 / (a0 + a1 + 0.5) + 1 / (b0 + b1 + 0.5))
        if cautious >= least_odds:
            sure.append((cautious * math.sqrt(a0 + a1), len(stem), stem, odds))
    chosen: dict[str, float] = {}
    barred: set[str] = set()
    for _, _, stem, odds in sorted(sure, key=lambda x: (-x[0], -x[1], x[2])):
        if stem not in barred and not any(stem[:n] in chosen for n in range(1, len(stem))):
            chosen[stem] = odds
            barred.update(stem[:n] for n in range(1, len(stem) + 1))
    return chosen


def fit_curve(inputs: np.ndarray, toxic: np.ndarray, ridge: float = 0.1) -> tuple[float, float, float]:
    """Logistic regression by Newton's method."""
    x, w = np.column_stack([np.ones(len(inputs)), inputs]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - toxic) + ridge * np.array([0, w[1], w[2]])
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, ridge, ridge])
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1]), float(w[2])


def learn_lexicon(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, least_odds: float = 2.0, least_phrase: int = 5, exceptions: tuple[str, ...] = KNOWN_EXCEPTIONS) -> Lexicon:
    """Entries, exceptions (with those given) and curve from labelled documents outside the held-out fold, from at most sample_rows of them. Copies of a text count once; what is labelled both ways counts as toxic."""
    judged = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    sample = bounded_sample(judged.where(crc_bucket(F.col("doc_id")) != HELD_OUT), "doc_id", sample_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_toxic").alias("_toxic"))
    rows = written(texts.groupBy("text").agg(F.max("_toxic").alias("_toxic")), "toxicity-sample")
    half = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")) % 2
    totals = tuple(rows.agg(*(F.count_if((half == h) & ((F.col("_toxic") == 1) == F.lit(toxic))).alias(f"{h}{toxic}") for h in (0, 1) for toxic in (False, True))).first())
    n_toxic, n_clean = totals[1] + totals[3], totals[0] + totals[2]
    if not n_toxic or not n_clean:
        return Lexicon()
    support = max(3, n_toxic // 300)
    spread = rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # What toxic texts do not use more often than clean ones cannot have the odds.
    likely = feature_counts(spread, stems_of).where((F.col("toxic_0") >= support) & (F.col("toxic_0_uses") * totals[0] > F.col("clean_0_uses") * totals[1]))
    weights = choose_stems([tuple(r) for r in likely.select("feature", *_COUNTS).collect()], totals, support, least_odds)
    key = Lexicon(weights).key()
    a, b = F.col("toxic_0") + F.col("toxic_1"), F.col("clean_0") + F.col("clean_1")
    phrases = feature_counts(spread, lambda text: phrases_of(text, automaton(key)))
    excused = phrases.where((b >= least_phrase) & (b * n_toxic > 4 * a * n_clean)).select("feature").collect()
    lexicon = Lexicon(weights, tuple(sorted({*exceptions, *(r["feature"] for r in excused)})))
    points = rows.select("_toxic", weighed(lexicon)("text").alias("m")).select("_toxic", "m.*").collect()
    curve = fit_curve(np.array([shape(r["total"], r["words"]) for r in points]), np.array([float(r["_toxic"] == 1) for r in points]))
    return Lexicon(weights, lexicon.exceptions, curve)


def score(lexicon: Lexicon, text: Column) -> Column:
    """The score of a text column, 0 to 1."""
    a, b, c = lexicon.curve
    m = weighed(lexicon)(text)
    z = F.lit(a) + F.lit(b) * F.log1p(m["total"]) + F.lit(c) * F.log1p(100 * m["total"] / (m["words"] + 20))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
