"""Quality rules: counts of every text, a fixed base rule, and a decision list that is learned from labels.

One pass over the texts, whole, counts words, symbols, repeated lines and repeated runs of words.  Shares made of the counts
are what rules speak of.  Sequential covering learns the list: a rule grows by the threshold that gains most on two thirds of
the labelled rows, until it covers one label alone; it is pruned from its end on the other third; what it covers is set
aside, and the next one grows.  The list becomes one conditional expression, ``CASE WHEN a AND b THEN false WHEN ... ELSE true
END``, that Spark evaluates on the counts.

Learning takes a bounded sample: at most ``per_class`` documents of each label, by a hash of doc_id, never from the held-out
fold of the quality classifier and only such as the base rule passes.  Only their shares reach the driver.  Texts are read
once; all else works on stored counts, a row of numbers per document.

Repeated runs are told by 64-bit hashes of their words and of their document; lines are compared as they are.

Defined cases: null and empty texts have no words and fail the base rule; texts of any length are counted whole; shares of a
text without words are 0; a document with several labels counts as its largest, labels other than 0 and 1 count as none; with
fewer than two labels to learn from there are no rules and what passes the base rule stays; rows that repeat, or share a
doc_id, are judged each by its own text and count once in the sample; an empty table gives an empty result.  Other columns are
passed on, but for those named as the counts, the shares or the verdicts, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.hashing import MULT, SPACE, scramble, word_hashes, word_spans
from tidemark.llm.quality import training_sample
from tidemark.llm.shared import stored, table, text_chunks

MIN_WORDS, REPEAT_PERCENT, RUN, PER_CLASS = 10, 20, 5, 5000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_single", "n_distinct")
#: Shares that rules may speak of: name, count, and what it is a share of.
SHARES = {
    "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"), "repeat_lines": ("n_dup_lines", "n_lines"), "repeat_words": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "word_chars"), "digits": ("n_digits", "word_chars"), "marks": ("n_marks", "n_words"), "single": ("n_single", "n_words"), "distinct": ("n_distinct", "n_words"),
}

_BYTE = np.arange(256)
_KINDS = {
    "word_chars": ~SPACE & ((_BYTE & 0xC0) != 0x80),  # bytes that begin a code point
    "n_symbols": np.isin(_BYTE, list(b"#*$%&|<>")),
    "n_upper": (_BYTE >= 65) & (_BYTE <= 90),
    "n_digits": (_BYTE >= 48) & (_BYTE <= 57),
    "n_marks": np.isin(_BYTE, list(b"!?")),
}
_BLANKS = b" \t\n\x0b\x0c\r"


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that an earlier line is equal to."""
    with_word = [line for line in text.split(b"\n") if line.strip(_BLANKS)]
    return len(with_word), len(with_word) - len(set(with_word))


def counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """``COUNTS`` of every text."""
    n = len(texts)
    data = [t + b"\n" for t in texts]
    raw = np.frombuffer(b"".join(data), dtype=np.uint8)
    edges = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    out = {}
    for name, kind in _KINDS.items():
        hits = np.concatenate([[0], np.cumsum(kind[raw], dtype=np.int64)])
        out[name] = hits[edges[1:]] - hits[edges[:-1]]
    start, end = word_spans(raw)
    doc = np.searchsorted(edges[1:], start, "right")
    per_doc = lambda owner: np.bincount(owner, minlength=n).astype(np.int64)
    out["n_words"] = per_doc(doc)
    first = np.concatenate([[0], np.cumsum(_KINDS["word_chars"][raw], dtype=np.int64)])
    out["n_single"] = per_doc(doc[first[end] - first[start] == 1])
    h = word_hashes(raw, start, end)
    out["n_distinct"] = per_doc(_of_first(h, doc))
    covered = np.zeros(len(h) + 1, dtype=np.int64)
    if len(h) >= RUN:
        run = np.zeros(len(h) - RUN + 1, dtype=np.uint64)
        for i in range(RUN):
            run = run * MULT + h[i : len(h) - RUN + 1 + i]
        at = np.flatnonzero(doc[: len(run)] == doc[RUN - 1 :])  # runs inside one text
        key = scramble(run[at] + doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(at), dtype=bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        np.add.at(covered, at[again], 1)
        np.add.at(covered, at[again] + RUN, -1)
    out["n_repeat_words"] = per_doc(doc[np.cumsum(covered)[:-1] > 0])
    lines = np.array([_lines(t) for t in texts], dtype=np.int64).reshape(-1, 2)
    out["n_lines"], out["n_dup_lines"] = lines[:, 0], lines[:, 1]
    return out


def _of_first(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The document of each word that is the first of its kind there."""
    key = scramble(h + doc.astype(np.uint64) * np.uint64(0x9E6C63D0876A9A47))
    order = np.argsort(key, kind="stable")
    key = key[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = key[1:] != key[:-1]
    return doc[order][fresh]


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``COUNTS``, each counted on its whole text."""
    docs = docs.drop(*COUNTS)
    schema = T.StructType([*docs.schema, *(T.StructField(c, T.LongType()) for c in COUNTS)])
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, 4 << 20):
            found = counts([t or b"" for t in pc.cast(batch.column("text"), pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[c]) for c in COUNTS)], names=[*names, *COUNTS])

    return docs.mapInArrow(run, schema)


def shares() -> dict[str, Column]:
    """``SHARES`` as columns; 0 where there is nothing to share."""
    return {name: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0) for name, (part, whole) in SHARES.items()}


def base_failed() -> Column:
    """Too few words, or too many of them in runs that repeat."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Threshold:
    share: str
    above: bool
    value: float

    def __str__(self) -> str:
        return f"{self.share} {'>' if self.above else '<='} {self.value:.6g}"

    def column(self) -> Column:
        return F.col(self.share) > self.value if self.above else F.col(self.share) <= self.value

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.share)]
        return v > self.value if self.above else v <= self.value


@dataclass(frozen=True)
class Rule:
    """All thresholds hold: not to be kept."""

    thresholds: tuple[Threshold, ...]

    def __str__(self) -> str:
        return " AND ".join(map(str, self.thresholds))

    def column(self) -> Column:
        return reduce(and_, [t.column() for t in self.thresholds])

    def covers(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        return reduce(and_, [t.holds(x, names) for t in self.thresholds], np.ones(len(x), dtype=bool))


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: false by the first rule that holds, else true."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), False) if out is None else out.when(rule.column(), False)
    return F.lit(True) if out is None else out.otherwise(True)


def _best(x: np.ndarray, bad: np.ndarray, names: list[str]) -> tuple[float, Threshold | None]:
    """The threshold with the most information gained about the rows that it leaves, times the bad ones among them."""
    total, n = bad.sum(), len(bad)
    before = np.log2(total / n)
    best: tuple[float, Threshold | None] = (1e-9, None)
    for k, name in enumerate(names):
        order = np.argsort(x[:, k], kind="stable")
        v, p = x[order, k], np.cumsum(bad[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        for above in (False, True):
            some, every = (total - p[cut], n - 1 - cut) if above else (p[cut], cut + 1)
            gain = some * (np.log2(np.maximum(some, 1e-9) / every) - before)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                low, high = v[cut[i]], v[cut[i] + 1]
                mid = (low + high) / 2
                best = (float(gain[i]), Threshold(name, above, float(mid if low <= mid < high else low)))
    return best


def grow(x: np.ndarray, bad: np.ndarray, names: list[str], longest: int = 4) -> Rule | None:
    """A rule that covers bad rows alone, as far as ``longest`` thresholds get."""
    rows, found = np.ones(len(bad), dtype=bool), []
    while len(found) < longest and bad[rows].any() and not bad[rows].all():
        _, threshold = _best(x[rows], bad[rows], names)
        if threshold is None:
            break
        found.append(threshold)
        rows &= threshold.holds(x, names)
    return Rule(tuple(found)) if found else None


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray, names: list[str]) -> Rule:
    """The shortest beginning of the rule that is worth most on rows that it did not grow on."""

    def worth(short: Rule) -> float:
        hit = short.covers(x, names)
        return (2.0 * bad[hit].sum() - hit.sum()) / max(1, hit.sum())

    return max((Rule(rule.thresholds[:k]) for k in range(1, len(rule.thresholds) + 1)), key=worth)


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], longest_list: int = 16, precision: float = 0.9, least: int = 3) -> list[Rule]:
    """Sequential covering: rules one after the other, until one is not worth having.

    A rule stays in the list if it covers ``least`` bad rows that no earlier one covers, and of all rows that it covers
    at least ``precision`` are bad.  Every third row is kept apart for pruning.
    """
    rules: list[Rule] = []
    open_ = np.ones(len(bad), dtype=bool)
    aside = np.arange(len(bad)) % 3 == 2
    while len(rules) < longest_list and bad[open_ & ~aside].any():
        rule = grow(x[open_ & ~aside], bad[open_ & ~aside], names)
        if rule is None:
            break
        if bad[open_ & aside].any():
            rule = prune(rule, x[open_ & aside], bad[open_ & aside], names)
        hit = rule.covers(x, names) & open_
        if bad[hit].sum() < least or bad[hit].sum() < precision * hit.sum():
            break
        rules.append(rule)
        open_ &= ~hit
    return rules


def learned_rules(counted: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> list[Rule]:
    """Rules from a bounded sample of labelled rows, which has 2 * ``per_class`` rows at most."""
    chosen = training_sample(labels, per_class)
    names = list(SHARES)
    rows = counted.where(~base_failed()).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", F.array(*shares().values()).alias("v"))
    rows = rows.groupBy("doc_id", "quality").agg(F.min("v").alias("v")).toPandas().sort_values("doc_id")
    bad = rows.quality.to_numpy() == 0
    if not len(rows) or bad.all() or not bad.any():
        return []
    return learn(np.stack(rows.v.to_numpy()).astype(float), bad, names)


def judge(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``docs`` without their text, with ``COUNTS``, ``SHARES``, ``base_failed`` and ``kept``."""
    counted = stored(with_counts(docs).drop("text"), "counts")
    rules = learned_rules(counted.select("doc_id", *COUNTS), labels, per_class)
    return counted.withColumns(shares()).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, table(spark, sf_dir, "labels")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
