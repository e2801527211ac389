"""Exact removal of repeated passages, with the offsets of what goes.

A text is cut into units: sentences, lines or paragraphs.  A unit is normalised (case folded, white space runs to one
blank, ends trimmed) and hashed to 128 bits.  Over the whole corpus the occurrence of a unit with the lowest rank (doc_id,
then place) stays and the rest are repeats.  Repeats that follow each other in a document make a passage; passages of
``min_words`` words in such units and more are reported for removal with their code point offsets in the original text.  Units
shorter than ``unit_words`` are too common to tell anything: they are not hashed, and go with a passage they lie in.

Sentences alone miss passages that begin or end inside one, and texts of very short ones.  ``repeated_runs``, which the
query runs, adds windows of ``min_words`` words: of every ``sure - min_words + 1`` windows in a row the one with the lowest
hash, and the first and last of a text.  What is chosen depends on the words in it alone, so a run of ``sure`` words that
repeats holds a chosen window that repeats, wherever it begins.  Windows and sentences that meet make one passage.

Plan: units and digests are made in the scan; digests, places and offsets are shuffled, texts are not.  First occurrences
come from a partially aggregated minimum, so a passage that a third of all documents share is one row per task; the join
back is one whose hot partitions adaptive execution can split.

Defined cases: null and empty texts have no units; texts of any length are cut whole; a passage repeated inside one document
goes too; rows without doc_id have no rank and take no part; rows that repeat a doc_id have equal ranks, so they keep what
their twin keeps, and are taken to have one text; of a run that repeats by overlapping itself, the part clear of the first
occurrence goes; an empty table gives an empty result; columns besides doc_id and text are ignored by the search and passed
on by ``without_passages``.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import skew_join, table, text_chunks

SEPARATORS = {"sentence": re.compile(r"(?<=[.!?])\s+|\n\s*"), "line": re.compile(r"\n"), "paragraph": re.compile(r"\n[ \t\r]*\n\s*")}
UNIT_WORDS, MIN_WORDS, SURE_WORDS = 4, 30, 50
#: White space as ``str.split`` reads it, by code point.
SPACE = np.array([chr(i).isspace() for i in range(0x3002)])
SENTENCE_END = np.array([chr(i) in ".!?" for i in range(128)])
KNOWN_FACTORS = 1 << 12


def units(text: str, kind: str = "sentence", unit_words: int = UNIT_WORDS) -> list[tuple[int, int, int, int, bytes]]:
    """``(place, start, end, words, digest)`` of the units that are long enough; places count those only."""
    out, start = [], 0
    for m in [*SEPARATORS[kind].finditer(text), None]:
        end = m.start() if m else len(text)
        words = text[start:end].split()
        if len(words) >= unit_words:
            out.append((len(out), start, end, len(words), hashlib.blake2b(" ".join(words).casefold().encode(), digest_size=16).digest()))
        start = m.end() if m else end
    return out


def unit_table(docs: DataFrame, kind: str = "sentence", unit_words: int = UNIT_WORDS) -> DataFrame:
    """``(doc_id, place, start, end, words, high, low)``, a row per unit; high and low are the digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, 4 << 20):
            found = [units(t or "", kind, unit_words) for t in batch.column("text").to_pylist()]
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
            place, start, end, words, digest = zip(*[u for f in found for u in f]) if len(owner) else [()] * 5
            halves = np.frombuffer(b"".join(digest), dtype=np.int64).reshape(-1, 2)
            numbers = [pa.array(c, pa.int32()) for c in (place, start, end, words)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner)), *numbers, pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["doc_id", "place", "start", "end", "words", "high", "low"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, place int, start int, end int, words int, high long, low long")


def repeated_units(docs: DataFrame, kind: str = "sentence", unit_words: int = UNIT_WORDS) -> DataFrame:
    """A row for every unit that repeats an earlier one: its place, offsets and words, and where the first one is."""
    every = unit_table(docs, kind, unit_words)
    place = F.struct("doc_id", "place")
    firsts = every.groupBy("high", "low").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("high", F.col("low").alias("same"), "first")
    back = skew_join(every, firsts, "high").where((F.col("low") == F.col("same")) & (F.struct("doc_id", "place") > F.col("first")))
    return back.select("doc_id", "place", "start", "end", "words", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.place").alias("kept_place"))


def repeated_passages(docs: DataFrame, kind: str = "sentence", unit_words: int = UNIT_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, start, end, n_words, n_units, kept_doc_id)``: a row per passage to remove; ``kept_doc_id`` holds its first unit."""
    run = F.col("place") - F.dense_rank().over(Window.partitionBy("doc_id").orderBy("place"))
    rows = repeated_units(docs, kind, unit_words).distinct().withColumn("run", run)
    passages = rows.groupBy("doc_id", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("n_words"), F.count("*").alias("n_units"), F.min_by("kept_doc_id", "place").alias("kept_doc_id")
    )
    return passages.where(F.col("n_words") >= min_words).drop("run")


def _mixed(z: np.ndarray) -> np.ndarray:
    """The last steps of splitmix64."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@functools.lru_cache(maxsize=8)
def _table(n: int, seed: int) -> np.ndarray:
    return _mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _factors(n: int, seed: int) -> np.ndarray:
    """The first ``n`` of a row of odd 64-bit numbers, the same for every text; a short row is kept."""
    return _table(KNOWN_FACTORS, seed)[:n] if n <= KNOWN_FACTORS else _table.__wrapped__(n, seed)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _edges(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of words."""
    inside = np.zeros(len(points) + 2, dtype=bool)
    np.logical_not(SPACE[np.minimum(points, len(SPACE) - 1)], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def _word_hashes(points: np.ndarray, begin: np.ndarray, close: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: sums of code points times the factor of their place, then mixed."""
    size = close - begin
    starts = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(starts, size)
    letters = points[place + np.repeat(begin, size)] + np.uint32(1)
    return _mixed(np.add.reduceat(letters * _factors(int(size.max()), 3)[place], starts))


def _sentences(points: np.ndarray, begin: np.ndarray, close: np.ndarray) -> np.ndarray:
    """The words that begin a sentence, as SEPARATORS cuts them, and the number of words."""
    ends = np.flatnonzero(SENTENCE_END[np.minimum(points[close[:-1] - 1], 127)]) + 1
    lines = np.searchsorted(begin, np.flatnonzero(points == 10))
    return np.unique(np.concatenate([[0], ends, lines, [len(begin)]]))


def spans(text: str, unit_words: int = UNIT_WORDS, min_words: int = MIN_WORDS, sure: int = SURE_WORDS) -> tuple[np.ndarray, ...] | None:
    """``(word, words, after, start, end, high, low)`` of the sentences and chosen windows of a text, or None.

    ``word`` counts all words of the text; ``after`` is where the long sentence before ends (a window's own ``word``).
    """
    points = _points(text)
    begin, close = _edges(points)
    n = len(begin)
    if n < unit_words:
        return None
    # folding keeps the number of words, and their places too unless a letter becomes several
    folded = _points(text.casefold())
    h = _word_hashes(folded, *((begin, close) if len(folded) == len(points) else _edges(folded)))

    cuts = _sentences(points, begin, close)
    size = np.diff(cuts)
    place = np.arange(n) - np.repeat(cuts[:-1], size)
    long = np.flatnonzero(size >= unit_words)
    sums = [np.add.reduceat(h * _factors(int(size.max()), seed)[place], cuts[:-1])[long] for seed in (1, 2)]
    word, words = cuts[:-1][long], size[long]
    after = np.concatenate([word[:1], (word + words)[:-1]])

    m, w = n - min_words + 1, sure - min_words + 1
    if m > 0:
        first = np.correlate(h, _factors(min_words, 1), "valid")
        lowest = np.lib.stride_tricks.sliding_window_view(first, min(m, w)).argmin(axis=1)
        chosen = np.unique(np.concatenate([[0], lowest + np.arange(len(lowest)), [m - 1]]))
        second = (np.lib.stride_tricks.sliding_window_view(h, min_words)[chosen] * _factors(min_words, 2)).sum(axis=1, dtype=np.uint64)
        word, words, after = np.concatenate([word, chosen]), np.concatenate([words, np.full(len(chosen), min_words)]), np.concatenate([after, chosen])
        sums = [np.concatenate([sums[0], first[chosen]]), np.concatenate([sums[1], second])]
    return word, words, after, begin[word], close[word + words - 1], sums[0].view(np.int64), sums[1].view(np.int64)


def span_table(docs: DataFrame, unit_words: int = UNIT_WORDS, min_words: int = MIN_WORDS, sure: int = SURE_WORDS) -> DataFrame:
    """``(doc_id, word, words, after, start, end, high, low)``, a row per sentence and chosen window."""
    names = ["word", "words", "after", "start", "end", "high", "low"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, 4 << 20):
            found = [spans(t or "", unit_words, min_words, sure) for t in batch.column("text").to_pylist()]
            some = [f for f in found if f is not None]
            if not some:
                continue
            owner = np.repeat(np.arange(len(found)), [0 if f is None else len(f[0]) for f in found])
            columns = [pa.array(np.concatenate(c), pa.int64() if k > 4 else pa.int32()) for k, c in enumerate(zip(*some))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner)), *columns], names=["doc_id", *names])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, word int, words int, after int, start int, end int, high long, low long")


def _two(upper: Column, lower: Column) -> Column:
    """Two whole numbers from 0 to 2^31 - 1 in one, in the order of the first, then the second."""
    return F.shiftleft(upper.cast("long"), 32) + lower


def _upper(pair: str) -> Column:
    return F.shiftright(pair, 32).cast("int")


def _lower(pair: str) -> Column:
    return F.col(pair).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def packed(spans: DataFrame) -> DataFrame:
    """The rows of ``span_table`` with five of their numbers in three: this is what gets shuffled twice."""
    at, chars = _two(F.col("word"), F.col("words")), _two(F.col("start"), F.col("end") - F.col("start"))
    return spans.select("high", "low", "doc_id", at.alias("at"), chars.alias("chars"), (F.col("word") - F.col("after")).alias("gap"))


def unpacked(rows: DataFrame) -> DataFrame:
    numbers = {"word": _upper("at"), "words": _lower("at"), "after": _upper("at") - F.col("gap"), "start": _upper("chars"), "end": _upper("chars") + _lower("chars")}
    return rows.withColumns(numbers).drop("at", "chars", "gap")


def repeated_runs(docs: DataFrame, unit_words: int = UNIT_WORDS, min_words: int = MIN_WORDS, sure: int = SURE_WORDS) -> DataFrame:
    """As ``repeated_passages``, from sentences and windows: runs of ``sure`` words that repeat are found wherever they begin.

    ``n_words`` are all words between start and end, and ``n_units`` the sentences and windows that repeat there.
    """
    if not 0 < unit_words <= min_words <= sure:
        raise ValueError("0 < unit_words <= min_words <= sure")
    every = packed(span_table(docs, unit_words, min_words, sure))
    place = F.struct("doc_id", _upper("at").alias("word"))
    firsts = every.groupBy("high", "low").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("high", F.col("low").alias("same"), "first")
    clear = (F.col("doc_id") > F.col("first.doc_id")) | (_upper("at") >= F.col("first.word") + _lower("at"))
    back = skew_join(every, firsts, "high").where((F.col("low") == F.col("same")) & (place > F.col("first")) & clear)
    rows = unpacked(back.select("doc_id", "at", "chars", "gap", F.col("first.doc_id").alias("kept_doc_id")).distinct())
    order = Window.partitionBy("doc_id").orderBy("word", "words", "after", "kept_doc_id")
    reach = F.max(F.col("word") + F.col("words")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("apart", F.coalesce(F.col("after") > reach, F.lit(True)).cast("int")).withColumn("run", F.sum("apart").over(order))
    passages = rows.groupBy("doc_id", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max(F.col("word") + F.col("words")) - F.min("word")).alias("n_words"), F.count("*").alias("n_units"),
        F.min_by("kept_doc_id", F.struct("word", "words", "kept_doc_id")).alias("kept_doc_id"), F.sum("words").alias("hashed"),
    )
    return passages.where(F.col("hashed") >= min_words).drop("run", "hashed")


def without_passages(docs: DataFrame, find=repeated_passages, **options) -> DataFrame:
    """``docs`` with the passages that ``find`` reports cut out of ``text``."""
    cuts = find(docs, **options).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_cuts"))
    both = docs.join(cuts, "doc_id", "left")
    n = F.size("_cuts")
    from_ = lambda i: F.when(i == 0, 0).otherwise(F.element_at("_cuts", F.greatest(i, F.lit(1)))["end"])
    to = lambda i: F.when(i == n, F.char_length("text")).otherwise(F.element_at("_cuts", F.least(i + 1, n))["start"])
    kept = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring("text", from_(i) + 1, to(i) - from_(i)))
    return both.withColumn("text", F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(F.array_join(kept, ""))).select(*docs.columns)


def op3_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_runs(table(spark, sf_dir, "documents"))
