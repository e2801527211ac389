"""Phrase collocations by SON partitioning: shards are mined apart, and what is frequent in one of them is counted everywhere.

Texts are put in lower case (A-Z), cut into pieces at marks and line ends, and pieces into words.  Everything is counted per
language.  A phrase that occurs ``least`` times in all occurs ``least / SHARDS`` times in one shard at least, so:

1. Every shard is mined completely at that lowered support, on hashes: words and pairs in one pass, and each further length in
   a pass of its own, for phrases whose two shorter parts are frequent in the shard.  A shard is a part of the documents (by a
   hash of the text), however many tasks read it; counts are made in the task first.
2. The union of what is frequent in some shard are the candidates.
3. All candidates are counted exactly, by their words, over all documents.

Passes meet the frequent phrases as a bitmap of fixed size (``FILTER_BITS``), so nothing that grows is broadcast.  A bit that
two phrases share lets some more through to a count, which costs time and nothing else.  Within a task equal phrases are
told by 64-bit hashes.

Scores: a phrase of ``a`` occurrences, cut into parts of ``l`` and ``r``, has floor(1000000 * a * a / (l * r)); its lowest cut
counts, the smallest of equal ones.  A phrase of which half the occurrences and more lie inside one longer candidate is left
out.  It is enough to look at candidates longer by one word: what lies between has as many occurrences at least.

Defined cases: null texts are empty, null languages are "und"; texts and words of any length are taken whole; rows that repeat
count each; phrases of equal score come by count, then by the order of their UTF-8 bytes; an empty table gives an empty
result; columns besides text and lang are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.hashing import LOWER, MULT, scramble, word_hashes
from tidemark.llm.shared import skew_join, stored, table, text_chunks

LEAST, LONGEST, TOP, SHARDS = 10, 3, 2000, 4
#: Bits of a filter (16 MB), and of the pieces that the session's bitmap functions make.
FILTER_BITS, BITMAP_BITS = 1 << 27, 32768
#: Phrases that a task holds before it counts them, and bytes of text that it takes apart at once (a longer text stays whole).
HELD, CHUNK = 1_000_000, 1 << 19
#: Rows of a batch that a task gives back.
GIVEN = 65_536
ENDS = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
APART = ENDS | np.isin(np.arange(256), list(b" \t"))


class Words:
    """The words of some texts, and hashes of all phrases in them."""

    def __init__(self, texts: list[bytes], langs: list[str]) -> None:
        data = [t + b"\n" for t in texts]
        self.raw = LOWER[np.frombuffer(b"".join(data) + b" ", dtype=np.uint8)]
        edge = np.diff(np.concatenate([[True], APART[self.raw], [True]]).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.piece = np.cumsum(ENDS[self.raw], dtype=np.int32)[self.start]
        self.doc = np.searchsorted(np.cumsum([len(d) for d in data]), self.start, "right")
        seeds = {lang: int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little") for lang in set(langs)}
        seed = np.array([seeds[lang] for lang in langs], dtype=np.uint64)
        self.word = word_hashes(self.raw, self.start, self.end)
        self.grams = [scramble(self.word + seed[self.doc])] if len(self.word) else [self.word]

    def gram(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first words of all phrases of ``k`` words, and the phrases' hashes."""
        n = len(self.word)
        while len(self.grams) < k:
            size, before = len(self.grams) + 1, self.grams[-1]
            self.grams.append(scramble(before[: max(0, n - size + 1)] * MULT + self.word[size - 1 :]))
        at = np.flatnonzero(self.piece[: max(0, n - k + 1)] == self.piece[k - 1 :])
        return at, self.grams[k - 1][at]

    def text(self, at: np.ndarray, k: int) -> pa.Array:
        """The phrases of ``k`` words from these places, words apart by one blank."""
        from_, to = np.empty((len(at), 2 * k - 1), dtype=np.int64), np.empty((len(at), 2 * k - 1), dtype=np.int64)
        from_[:, 1::2], to[:, 1::2] = len(self.raw) - 1, len(self.raw)  # the blank at the end
        for j in range(k):
            from_[:, 2 * j], to[:, 2 * j] = self.start[at + j], self.end[at + j]
        size = (to - from_).ravel()
        past = np.concatenate([[0], np.cumsum(size)])
        data = self.raw[np.repeat(from_.ravel() - past[:-1], size) + np.arange(past[-1])]
        offsets = past[:: 2 * k - 1].astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


class Filter:
    """A bitmap of hashes that every task has."""

    def __init__(self, keys: DataFrame) -> None:
        """``keys`` has one column ``h``."""
        place = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
        maps = keys.groupBy(F.floor(place / BITMAP_BITS).alias("part")).agg(F.bitmap_construct_agg(place % BITMAP_BITS).alias("map")).collect()
        bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
        for r in maps:  # FILTER_BITS / BITMAP_BITS rows at most
            at = r.part * (BITMAP_BITS // 8)
            own = np.frombuffer(bytes(r.map), dtype=np.uint8)[: len(bits) - at]
            bits[at : at + len(own)] = own
        self.shared = keys.sparkSession.sparkContext.broadcast(bits)

    def has(self, h: np.ndarray) -> np.ndarray:
        place = h & np.uint64(FILTER_BITS - 1)
        return (self.shared.value[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _in_shard(h: np.ndarray, shard: np.ndarray) -> np.ndarray:
    return scramble(h + (shard.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E6C63D0876A9A47))


def _texts(docs: DataFrame, shards: int) -> DataFrame:
    shard = F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int")
    return docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")).withColumn("shard", shard)


def _read(batch: pa.RecordBatch) -> Words:
    return Words(pc.cast(batch.column("text"), pa.binary()).to_pylist(), batch.column("lang").to_pylist())


def local_counts(texts: DataFrame, hashes: Callable[[Words, np.ndarray], list[tuple[np.ndarray, np.ndarray]]], support: int) -> DataFrame:
    """``(shard, h)`` of phrases that occur ``support`` times in a shard.

    ``hashes`` gives (places, hashes) of the phrases to count, from the words of some texts and the shard of each word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for shard, parts in sorted(held.items()):
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                for i in range(0, len(h), GIVEN):
                    own = [pa.array(np.full(len(h[i : i + GIVEN]), shard, dtype=np.int32)), pa.array(h[i : i + GIVEN].view(np.int64)), pa.array(n[i : i + GIVEN].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(own, names=["shard", "h", "n"])
            held.clear()

        for batch in text_chunks(batches, CHUNK):
            words, own = _read(batch), batch.column("shard").to_numpy()
            shard = own[words.doc]
            for at, h in hashes(words, shard):
                for s in np.unique(own).tolist():
                    part = h[shard[at] == s]
                    if len(part):
                        held.setdefault(s, []).append(part)
                        size += len(part)
            if size >= HELD:
                yield from counted()
                size = 0
        yield from counted()

    rows = texts.mapInArrow(run, "shard int, h long, n long").groupBy("shard", "h").agg(F.sum("n").alias("n"))
    return rows.where(F.col("n") >= support).select("shard", "h")


def candidates(texts: DataFrame, least: int, longest: int, shards: int) -> DataFrame:
    """``h`` of every phrase that is frequent in some shard, each once; with a few others of equal hash."""
    support = -(-least // shards)
    union = level = stored(local_counts(texts, lambda words, shard: [words.gram(k) for k in range(1, min(2, longest) + 1)], support), "local")
    for k in range(3, longest + 1):
        # hashes of words and pairs stay apart, so one filter serves for all of them
        known = Filter(level.select(_shard_hash()))

        def longer(words: Words, shard: np.ndarray, k: int = k, known: Filter = known) -> list[tuple[np.ndarray, np.ndarray]]:
            (at, h), (begin, short) = words.gram(k), words.gram(k - 1)
            often = np.zeros(len(words.word) + 1, dtype=bool)
            often[begin] = known.has(_in_shard(short, shard[begin]))
            both = often[at] & often[at + 1]
            return [(at[both], h[both])]

        level = stored(local_counts(texts, longer, support), "local")
        known.shared.destroy()
        union = union.unionByName(level)
    return union.select("h").distinct()


def _shard_hash() -> Column:
    """What ``_in_shard`` gives, as a column: computed in Arrow batches, as whole numbers wrap around there."""

    @F.pandas_udf("long")
    def mixed(h: pd.Series, shard: pd.Series) -> pd.Series:
        return pd.Series(_in_shard(h.to_numpy(np.int64).view(np.uint64), shard.to_numpy()).view(np.int64))

    return mixed("h", "shard").alias("h")


def counted(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS) -> DataFrame:
    """``(lang, phrase, size, n)`` of all phrases of 1 to ``longest`` words that occur ``least`` times; a null phrase of size 0
    holds the number of words of the language."""
    texts = _texts(docs, shards)
    wanted = Filter(candidates(texts, least, longest, shards))
    names = ["lang", "phrase", "size", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, pa.Table]] = []
        size = 0

        def merged() -> Iterator[pa.RecordBatch]:
            h = np.concatenate([k for k, _ in held])
            rows = pa.concat_tables([t for _, t in held])
            _, first, group = np.unique(h, return_index=True, return_inverse=True)
            n = np.bincount(group, weights=rows.column("n").to_numpy()).astype(np.int64)  # below 2^53, so exact
            held.clear()
            yield from rows.take(pa.array(first)).set_column(3, "n", pa.array(n)).to_batches(GIVEN)

        for batch in text_chunks(batches, CHUNK):
            words, lang = _read(batch), batch.column("lang")
            each = np.bincount(words.doc, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([lang, pa.nulls(batch.num_rows, pa.string()), pa.array(np.zeros(batch.num_rows, dtype=np.int32)), pa.array(each.astype(np.int64))], names=names)
            for k in range(1, longest + 1):
                at, h = words.gram(k)
                on = wanted.has(h)
                h, first, n = np.unique(h[on], return_index=True, return_counts=True)
                at = at[on][first]
                if len(at):
                    columns = [lang.take(pa.array(words.doc[at])), words.text(at, k), pa.array(np.full(len(at), k, dtype=np.int32)), pa.array(n.astype(np.int64))]
                    held.append((h, pa.Table.from_arrays(columns, names=names)))
                    size += len(at)
            if size >= HELD // 4:
                yield from merged()
                size = 0
        if held:
            yield from merged()

    rows = texts.drop("shard").mapInArrow(run, "lang string, phrase string, size int, n long").groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))
    out = stored(rows.where((F.col("n") >= least) | (F.col("size") == 0)), "phrases")
    wanted.shared.destroy()
    return out


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, shards: int = SHARDS, inside_percent: int = 50) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of 2 to ``longest`` words of each language."""
    rows = counted(docs, least, longest, shards)
    key = lambda lang, phrase: F.concat(lang, F.lit("\n"), phrase).alias("key")  # a line end is in no phrase
    known = rows.where("size > 0").select(key(F.col("lang"), F.col("phrase")), F.col("n").alias("f"))
    some = rows.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))
    words = F.split("phrase", " ")
    part = lambda from_, n: F.array_join(F.slice(words, from_, n), " ")
    cuts = some.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"key": key(F.col("lang"), part(F.lit(1), F.col("k"))), "rest": key(F.col("lang"), part(F.col("k") + 1, F.col("size") - F.col("k")))})
    cuts = skew_join(cuts, known.withColumnRenamed("f", "l"), "key").withColumn("key", F.col("rest"))
    cuts = skew_join(cuts, known.withColumnRenamed("f", "r"), "key")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"top": (F.lit(1_000_000).cast("decimal(7,0)") * whole("a") * whole("a")).cast("decimal(38,0)"), "under": (whole("l") * whole("r")).cast("decimal(38,0)")})
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("top div under").alias("score"), "k", "l", "r")).alias("cut"))
    # parts that are shorter by a word, with the most frequent phrase around them
    ends = some.where("size > 2").withColumn("phrase", F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))))
    around = ends.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    free = best.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < inside_percent * F.col("a")))
    n = rows.where("size = 0").select("lang", "n")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    first = free.withColumn("rank", place.cast("long")).where(F.col("rank") <= top)
    return first.join(n, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part
  FROM documents
), w AS (
  SELECT lang, list_filter(string_split_regex(part, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
), s AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, k AS size, unnest(list_transform(range(1, greatest(0, len(ws) - k + 1) + 1), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3)) AS v(k)
), f AS (
  SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 10
), c AS (
  SELECT f.lang, f.phrase, f.size, f.a, v.k, x.a AS l, y.a AS r, (1000000::HUGEINT * f.a * f.a) // (x.a::HUGEINT * y.a) AS score
  FROM f JOIN (VALUES (1), (2)) AS v(k) ON v.k < f.size
  JOIN f x ON x.lang = f.lang AND x.phrase = array_to_string(string_split(f.phrase, ' ')[1 : v.k], ' ')
  JOIN f y ON y.lang = f.lang AND y.phrase = array_to_string(string_split(f.phrase, ' ')[v.k + 1 :], ' ')
), b AS (
  SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), o AS (
  SELECT lang, phrase, max(a) AS around FROM (
    SELECT lang, a, array_to_string(string_split(phrase, ' ')[1 : 2], ' ') AS phrase FROM f WHERE size = 3
    UNION ALL SELECT lang, a, array_to_string(string_split(phrase, ' ')[2 : 3], ' ') FROM f WHERE size = 3
  ) GROUP BY ALL
), t AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.around IS NULL OR 100 * o.around < 50 * b.a
)
SELECT t.lang, t.rank, t.phrase, t.a, t.l, t.r, s.n, t.score::BIGINT AS score FROM t JOIN s ON s.lang = t.lang WHERE t.rank <= 2000
"""
