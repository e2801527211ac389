"""Mix sources to target weights by weighted fair queueing, with DataFrame operations only.

Each document may be taken up to ``epochs`` times.  A source's documents are shuffled by a seeded hash; a copy's virtual
finish time is the number of source words served up to and including it, divided by the source's target.  All copies
are ordered by finish time over all sources and taken while the running total stays within the budget.

Both running totals are distributed: hash (or time) intervals get their sums from a partial aggregate, interval sums are
accumulated level by level, 4,096 intervals at a time, and each interval is then accumulated on its own.  Intervals are so
many that each holds about ``rows_per_bucket`` rows, whatever the size of the source, so a source with a third of all rows
is spread like any other, and no window of any level grows with the tables.  The one table that a single task sees whole is
that of the sources, a row each: water filling needs all of them in order.

Defined cases: a null text has size 0; null sources are a source of their own, ordered last; documents of size 0 are
taken zero words; texts of any length are counted whole; ties of hash and finish time go by doc_id; an empty table gives an
empty result.  Rows that repeat a doc_id are separate documents with the same place in the order, each with a fate of its
own.  Columns other than doc_id, source and text are passed on by ``mixed`` and ignored by ``fair_queue``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import stored, table

WEIGHTS, EPOCHS, SHARE = (3.0, 1.0, 2.0), 2, 1.5
HASH_BITS = 60


def word_count(text: Column) -> Column:
    """Number of stretches without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def shuffle_key(seed: str = "mix") -> Column:
    """60 bits of an MD5 of seed and document: uniform, and the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def _mark() -> Column:
    return F.xxhash64(F.col("text")).alias("mark")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``(source, source_size, n_docs, target)``: one row per source.

    Shares by weight, held at ``epochs`` times the source's size with the excess shared out again, is water filling:
    with sources ordered by limit / weight, the first one whose limit is above its share of what is left sets the level.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    weight = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(w) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("limit", (F.col("source_size") * epochs).cast("double"))
    everything = Window.partitionBy(F.lit(0))
    by = by.withColumn("n", F.row_number().over(everything.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())))
    before = F.sum("limit").over(everything.orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    onward = F.sum("weight").over(everything.orderBy("n").rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("level", (F.sum("source_size").over(everything) * share - F.coalesce(before, F.lit(0.0))) / onward)
    opened = F.when(F.col("limit") > F.col("level") * F.col("weight"), F.struct("n", "level"))
    level = F.min(opened).over(everything)["level"]
    return by.select("source", "source_size", "n_docs", F.coalesce(F.least("limit", level * F.col("weight")), "limit").alias("target"))


LEVEL_BITS = 12


def _past(sums: DataFrame, group: list[str], bits: int) -> DataFrame:
    """``sums(group, bucket, sum)`` with ``past``, the sum of all buckets of the group before; buckets are below 2 ** bits.

    Windows hold 2 ** LEVEL_BITS buckets at most: longer ranges are cut into coarser buckets, whose own past comes first.
    """
    before = lambda *keys: Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    if bits <= LEVEL_BITS:
        return sums.withColumn("past", F.coalesce(F.sum("sum").over(before(*group)), F.lit(0)))
    sums = sums.withColumn("coarse", F.shiftright("bucket", LEVEL_BITS))
    coarse = sums.groupBy(*group, F.col("coarse").alias("bucket")).agg(F.sum("sum").alias("sum"))
    coarse = _past(coarse, group, bits - LEVEL_BITS).drop("sum")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in group] + [F.col("a.coarse") == F.col("b.bucket")]
    both = sums.withColumn("inner", F.coalesce(F.sum("sum").over(before(*group, "coarse")), F.lit(0))).alias("a").join(coarse.alias("b"), on=same)
    return both.select(*[F.col(f"a.{k}") for k in [*group, "bucket", "sum"]], (F.col("a.inner") + F.col("b.past")).alias("past"))


def _running(df: DataFrame, group: list[str], bits: int, order: list, value: str, out: str) -> DataFrame:
    """Running total of ``value`` in ``group``: totals of the buckets before, plus the running total inside the bucket."""
    keys = [*group, "bucket"]
    sums = _past(df.groupBy(*keys).agg(F.sum(value).alias("sum")), group, bits)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = df.alias("a").join(sums.alias("b"), on=same).select("a.*", "b.past")
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.col("past") + F.sum(value).over(inside)).drop("past")


def fair_queue(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = "mix", rows_per_bucket: int = 512) -> DataFrame:
    """``(doc_id, source, mark, size, source_size, target, copies, taken)`` for every row of ``docs(doc_id, source, text)``.

    ``mark`` is a hash of the text, which tells rows that repeat a doc_id apart.
    """
    sized = stored(docs.select("doc_id", "source", _mark(), word_count(F.col("text")).alias("size")), "sized")
    targets = stored(source_targets(sized, weights, share, epochs).coalesce(1), "targets")
    largest, n_docs, words = targets.agg(F.max("n_docs"), F.sum("n_docs"), F.sum("source_size")).first()
    bits = lambda n: max(0, math.ceil(math.log2(max(1, (n or 0) / rows_per_bucket))))
    n_slots = 2 ** bits((n_docs or 0) * epochs)
    sized = sized.withColumn("r", shuffle_key(seed)).withColumn("bucket", F.shiftright("r", HASH_BITS - bits(largest)))
    queued = _running(sized, ["source"], bits(largest), ["r", "doc_id", "size"], "size", "served")
    queued = queued.alias("q").join(targets.alias("t"), F.col("q.source").eqNullSafe(F.col("t.source"))).select("q.*", "t.source_size", "t.target")
    queued = stored(queued.drop("bucket"), "queued")

    def finish(epoch: int) -> Column:
        served = F.col("served") + F.lit(epoch) * F.col("source_size")
        return F.when(F.col("target") > 0, served / F.col("target")).otherwise(F.lit(0.0))

    def place(epoch: int) -> Column:
        """Total order of all copies: finish time, then source (null last), hash and document."""
        return F.struct(finish(epoch).alias("finish"), F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("source"), "r", "doc_id", F.lit(epoch).alias("epoch"))

    copies = queued.select("size", F.explode(F.array(*[place(i) for i in range(epochs)])).alias("place"))
    copies = copies.withColumn("slot", F.least(F.col("place.finish") / epochs * n_slots, F.lit(16.0 * n_slots)).cast("long"))
    last = _last_within(copies, float(words or 0) * share, epochs)
    taken = sum((F.coalesce((place(i) <= last).cast("long"), F.lit(0)) for i in range(epochs)), F.lit(0).cast("long"))
    return queued.withColumn("copies", taken).withColumn("taken", F.col("copies") * F.col("size")).drop("r", "served")


def _last_within(copies: DataFrame, budget: float, epochs: int) -> Column:
    """The place of the last copy, in global order, up to which the running total stays within the budget.

    The order is cut into ranges of finish time (slots).  Sums of the slots say in which one the budget ends, found from
    coarse ranges of slots down to fine ones, 4,096 at a time; only that slot is sorted.  A literal row is returned: it is one
    value, however many copies there are.
    """
    sums = stored(copies.groupBy("slot").agg(F.sum("size").alias("words")), "slots")
    top = sums.agg(F.max("slot").alias("slot")).first()["slot"]
    if top is None:
        return F.lit(None)
    shift, slot, past = LEVEL_BITS * ((max(1, top).bit_length() - 1) // LEVEL_BITS), None, 0
    while shift >= 0:
        inside = sums if slot is None else sums.where(F.shiftright("slot", shift + LEVEL_BITS) == slot)
        level = inside.groupBy(F.shiftright("slot", shift).alias("bucket")).agg(F.sum("words").alias("sum"))
        level = _past(level.withColumn("all", F.lit(0)), ["all"], LEVEL_BITS).withColumn("past", F.col("past") + F.lit(past))
        end = level.where(F.col("past") <= budget).agg(F.max(F.struct("bucket", "past")).alias("end")).first()["end"]
        slot, past, shift = end["bucket"], end["past"], shift - LEVEL_BITS
    end = {"slot": slot, "past": past}
    order = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    inside = copies.where(F.col("slot") == end["slot"]).withColumn("total", F.sum("size").over(order) + F.lit(end["past"]))
    row = inside.where(F.col("total") <= budget).agg(F.max("place").alias("place")).first()["place"]
    if row is None:  # the budget ends before this slot's first copy
        row = copies.where(F.col("slot") < end["slot"]).agg(F.max("place").alias("place")).first()["place"]
    if row is None:
        return F.lit(None)
    kinds = dict(copies.select("place.*").dtypes)
    return F.struct(*[F.lit(row[k]).cast(kind).alias(k) for k, kind in kinds.items()])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: documents repeated as often as they are taken, in the columns of ``docs``."""
    same = ["doc_id", "mark", "source"]
    twin = lambda *order: F.row_number().over(Window.partitionBy(*same).orderBy(*order)).alias("twin")
    copies = fair_queue(docs, **options).select(*same, F.col("copies").cast("int").alias("copies"))
    copies = copies.select("*", twin(F.desc("copies"))).where("copies > 0")
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", _mark(), "source")
    rows = rows.select("*", twin("doc_id"))
    both = rows.alias("r").join(copies.alias("c"), [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*same, "twin"]])
    return both.select("r.row", F.explode(F.sequence(F.lit(1), F.col("c.copies"))).alias("copy")).select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return fair_queue(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS r
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source
), w AS (
  SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, (source_size * 2)::DOUBLE AS lim FROM s
), n AS (
  SELECT *, row_number() OVER (ORDER BY lim / weight, source NULLS LAST) AS n FROM w
), l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(lim) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM n
), t AS (
  SELECT source, source_size,
         least(lim, weight * coalesce(arg_min(level, n) FILTER (lim > level * weight) OVER (), 1e300)) AS target FROM l
), q AS (
  SELECT d.*, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.r, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS served
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT q.*, e.epoch, CASE WHEN target > 0 THEN (served + epoch * source_size)::DOUBLE / target ELSE 0 END AS finish
  FROM q, (VALUES (0), (1)) e(epoch)
), g AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source IS NULL, coalesce(source, ''), r, doc_id, epoch ROWS UNBOUNDED PRECEDING) AS total FROM c
)
SELECT doc_id, size, source_size, target, sum(CASE WHEN total <= 1.5 * (SELECT sum(size) FROM d) THEN size ELSE 0 END)::BIGINT AS taken
FROM g GROUP BY doc_id, size, source_size, target
"""
