"""Exact line deduplication with DataFrame operations only.

Every text is split at newlines.  A line's key is the line without ASCII white space at both ends and with A-Z in
lower case.  Keys of at least ``min_chars`` code points that occur in two documents or more keep their lines in the
smallest document only.  The operator returns bitmaps, not texts.

Plan: one scan turns lines into 128-bit hashes of their keys and stores the rows ``(hash, doc_id, place)``.  Those small
rows are range-partitioned by hash and sorted once, by hash, document and place; a running first document is streamed along
each run of equal hashes.  Hashes that hold more than a share of a partition are found by a sketch of bounded size; each
is cut into slices by a salt, which comes after the hash in the range, and its first document is looked up in a small table
of the least documents of these hashes.  The sketch decides where rows go and nothing else.
A document's dropped places become its bitmap: stretches of kept lines.  Texts are not shuffled for that; they meet their
bitmaps when the caller asks for what is left of them.

Defined cases: a null or empty text is one empty line; very long lines and texts are taken whole; repeated lines inside
one document all stay or all go; rows that share a ``doc_id`` are one document as far as "two documents" is concerned,
and each keeps its own row and bitmap (rows are told apart by a hash of the text); rows with a null ``doc_id`` pass through
untouched; an empty table gives an empty result.  Other columns are passed on as they are, but for ``n_lines`` and
``n_dropped``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import partitions, stored, table

ENDS = " \t\n\x0b\x0c\r"
HASH = ["h1", "h2"]


def folded(x: Column) -> Column:
    """A text that two lines have in common just if they are equal with A-Z in lower case.

    The bytes are read as Latin-1 and put in lower case.  That changes A-Z, and first bytes of two-byte characters to those
    of longer ones; as the number of bytes that follow stays, different characters stay different.  It takes half the
    time of a translation of 26 letters.
    """
    return F.lower(F.decode(x.cast("binary"), "ISO-8859-1"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _text_mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hashed_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``(h1, h2, doc_id, mark, place, n_lines)`` of the lines whose key counts; places count from 0."""
    text = docs.where(F.col("doc_id").isNotNull()).select("doc_id", _text_mark(F.col("text")).alias("mark"), _lines(F.col("text")).alias("lines"))
    # the outer form: an array is never empty here, and the plain one would split every text twice to make sure of that
    rows = text.select("doc_id", "mark", F.size("lines").alias("n_lines"), F.posexplode_outer("lines").alias("place", "line"))
    rows = rows.withColumn("line", F.trim("line", F.lit(ENDS))).where(F.char_length("line") >= min_chars).withColumn("line", folded(F.col("line")))
    return rows.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "doc_id", "mark", "place", "n_lines")


#: A hash with more than one row in ``SHARE`` of a partition's is cut into slices.
SHARE = 4


def heavy_hashes(rows: DataFrame, parts: int) -> DataFrame:
    """``(h1, slices)`` of hashes with many rows; ``SHARE * parts`` rows at most, found by one sketch per task."""
    most = SHARE * parts
    found = rows.agg(F.expr(f"approx_top_k(h1, {min(most, 100_000)}, {min(10 * most, 1_000_000)})").alias("top"), F.count(F.lit(1)).alias("n"))
    each = found.select(F.explode("top").alias("t"), "n").where(F.col("t.count") * most > F.col("n"))
    return each.select(F.col("t.item").alias("h1"), F.ceil(F.col("t.count") * most / F.col("n")).alias("slices"))


def streamed_firsts(rows: DataFrame, heavy: DataFrame, parts: int) -> DataFrame:
    """``rows`` with ``first``, the least document of their hash; of heavy hashes, of their slice."""
    salt = F.coalesce(F.pmod(F.xxhash64("doc_id", "place"), F.col("slices")), F.lit(0))
    dealt = rows.join(F.broadcast(heavy), "h1", "left").withColumn("salt", salt).drop("slices").repartitionByRange(parts, *HASH, "salt")
    run = Window.partitionBy(*HASH, "salt").orderBy("doc_id", "place").rowsBetween(Window.unboundedPreceding, 0)
    return dealt.withColumn("first", F.first("doc_id").over(run))


def dropped_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``(doc_id, mark, place, n_lines)``: a row per line that an earlier document holds; places count from 0."""
    parts = partitions(docs.sparkSession)
    rows = stored(hashed_lines(docs, min_chars), "lines")
    heavy = stored(heavy_hashes(rows, parts), "heavy")
    # a row for each heavy hash, so both tables can be broadcast whatever the size of the documents
    least = rows.join(F.broadcast(heavy), "h1", "left_semi").groupBy(*HASH).agg(F.min("doc_id").alias("over_all"))
    gone = streamed_firsts(rows, heavy, parts).join(F.broadcast(least), HASH, "left").where(F.col("doc_id") > F.coalesce("over_all", "first"))
    return gone.select("doc_id", "mark", "place", "n_lines")


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``(doc_id, mark, n_lines, n_dropped, keep)`` for documents that lose lines.

    ``keep`` is the bitmap in run-length form: start and length of every stretch of lines that stay.
    """
    gone = dropped_lines(docs, min_chars).groupBy("doc_id", "mark").agg(F.max("n_lines").alias("n_lines"), F.array_sort(F.collect_set("place")).alias("gone"))
    last = F.size("gone") - 1
    before = lambda x, i: (i == 0) | (F.get("gone", i - 1) != x - 1)
    after = lambda x, i: (i == last) | (F.get("gone", i + 1) != x + 1)
    gone = gone.withColumns({"from": F.filter("gone", before), "to": F.filter("gone", after)})
    start = lambda j: F.coalesce(F.get("to", j - 1) + 1, F.lit(0))
    stretch = lambda j: F.struct(start(j).alias("start"), (F.coalesce(F.get("from", j), F.col("n_lines")) - start(j)).alias("length"))
    keep = F.filter(F.transform(F.sequence(F.lit(0), F.size("to")), stretch), lambda r: r["length"] > 0)
    return gone.select("doc_id", "mark", F.col("n_lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), keep.alias("keep"))


def _left(text: Column, keep: Column) -> Column:
    """The lines of the stretches ``keep``, joined again; texts and bitmaps are walked once, side by side."""
    end = lambda i: F.coalesce(F.get(keep, i - 1)["start"] + F.get(keep, i - 1)["length"], F.lit(0))
    times = lambda bit, n: F.array_repeat(F.lit(bit), n.cast("int"))
    bits = F.transform(keep, lambda r, i: F.concat(times(False, r["start"] - end(i)), times(True, r["length"])))
    return F.array_join(F.zip_with(_lines(text), F.flatten(bits), lambda line, bit: F.when(bit, line)), "\n")


def kept_text(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and the text that is left in ``text``; every other column stays as it is."""
    bitmaps = keep_bitmaps(docs, min_chars).select(F.col("doc_id").alias("id"), "mark", F.col("n_dropped").alias("gone"), "keep")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), _text_mark(F.col("text")).alias("mark"))
    text = F.coalesce("row.text", F.lit(""))
    new = {
        "text": F.when(F.col("keep").isNull(), text).otherwise(_left(text, F.col("keep"))),
        "n_lines": F.size(_lines(F.col("row.text"))).cast("long"),
        "n_dropped": F.coalesce("gone", F.lit(0).cast("long")),
    }
    old = [new["text"].alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return rows.join(bitmaps, ["id", "mark"], "left").select(*old, new["n_lines"].alias("n_lines"), new["n_dropped"].alias("n_dropped"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return kept_text(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > f.first, false) AS gone FROM k LEFT JOIN f USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
