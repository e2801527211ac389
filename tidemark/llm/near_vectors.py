"""Near-duplicate embeddings by cross-polytope hashing with fast Hadamard rotations and multiprobe buckets.

A hash function rotates a unit vector by three rounds of random signs and a Walsh-Hadamard transform and takes the
nearest of the 2d signed axes.  A table's bucket joins several of them; a vector enters the ``PROBES`` buckets whose axes
are nearest to it, in each of its tables.  Two vectors that share a bucket are a candidate pair, which is verified by its
cosine in double precision.

How many functions a bucket joins follows the number of vectors, so that a bucket of unrelated ones holds ``CROWD`` at most
on average, however many there are.  How many tables it takes then depends on the dimension: they are counted on random
pairs at a cosine of exactly the threshold, of which at most ``MISS`` may share no bucket (pairs above it are missed less).

Exact copies are collapsed first, so they cost one row.  Buckets are counted on numbers alone; those of one vector go before
any vector is copied.  A bucket of more than ``BLOCK`` vectors is cut into blocks, and pairs of blocks are verified as matrix
products in tasks of bounded size: nothing of a bucket is left out.  A pair that meets in several buckets counts in the
smallest one they share, which both sides know from their bucket lists, so no pair is ever written out: tasks return link
counts and, for connectivity, one edge per vector and block at most.

Defined cases: null, empty, zero and non-finite vectors link with nothing and are kept; vectors of different length
never link; very long vectors are taken whole; rows that repeat a vec_id are vectors of their own; ties of the component go
to the smallest vec_id; an empty table gives an empty result; columns besides vec_id and embedding are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.shared import map_groups, skew_join, stored, table
from tidemark.llm.vectors import matrix, unit, usable

PROBES, BLOCK, STRIP = 3, 4096, 512
CROWD, MISS, MAX_TABLES = 64, 0.002, 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows (a power of two long), scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        pairs = x.reshape(n, -1, 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def table_buckets(x: np.ndarray, table: int, functions: int, probes: int = PROBES) -> np.ndarray:
    """The ``probes`` nearest buckets of each unit vector in one table, unique over tables and dimensions."""
    n, d = x.shape
    width = _width(d)
    x = np.pad(x, ((0, 0), (0, width - d)))
    reach = min(probes + 1, 2 * width)
    rng = np.random.default_rng((table, d))
    code, cost = np.zeros((n, 1), dtype=np.int64), np.zeros((n, 1))
    for _ in range(functions):
        y = x
        for _ in range(3):
            y = hadamard(y * rng.choice([-1.0, 1.0], size=width))
        axes = np.concatenate([y, -y], axis=1)
        top = np.argpartition(-axes, reach - 1, axis=1)[:, :reach]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(axes, top, axis=1), axis=1, kind="stable"), axis=1)
        value = np.take_along_axis(axes, top, axis=1)
        loss = (value[:, :1] - value) ** 2
        cost = (cost[:, :, None] + loss[:, None, :]).reshape(n, -1)
        code = (code[:, :, None] * (2 * width) + top[:, None, :]).reshape(n, -1)
        best = np.argsort(cost, axis=1, kind="stable")[:, : max(probes, reach)]
        cost, code = np.take_along_axis(cost, best, axis=1), np.take_along_axis(code, best, axis=1)
    mixed = (code[:, :probes].astype(np.uint64) * np.uint64(MAX_TABLES) + np.uint64(table)) * np.uint64(1 << 16) + np.uint64(d & 0xFFFF)
    return mixed.view(np.int64)


def _width(d: int) -> int:
    return 1 << max(1, (d - 1).bit_length())


def functions_for(d: int, n: int) -> int:
    """How many functions a bucket joins, so that n unrelated vectors leave ``CROWD`` in a bucket at most."""
    k = 2
    while n * PROBES > CROWD * (2 * _width(d)) ** k and (2 * _width(d)) ** (k + 1) < 1 << 40:
        k += 1
    return k


@functools.cache
def tables_for(d: int, functions: int, threshold: float, miss: float = MISS) -> int:
    """How many tables it takes until at most ``miss`` of random pairs at the threshold share no bucket."""
    rng = np.random.default_rng(d)
    n = max(500, min(4000, 512_000 // d))
    x, z = rng.normal(size=(2, n, d))
    x = unit(x)
    z -= (z * x).sum(1)[:, None] * x
    y = threshold * x + np.sqrt(1 - threshold**2) * (unit(z) if d > 1 else 0)
    apart = np.ones(n, dtype=bool)
    for table in range(MAX_TABLES):
        a, b = (table_buckets(unit(v), table, functions) for v in (x, y))
        apart &= ~(a[:, :, None] == b[:, None, :]).any(axis=(1, 2))
        if apart.mean() <= miss:
            return table + 1
    return MAX_TABLES


def hash_plan(d: int, n: int, threshold: float) -> tuple[int, int]:
    """Functions and tables for n vectors; fewer functions where no number of tables would find enough (very few dimensions)."""
    k = functions_for(d, n)
    while k > 2 and tables_for(d, k, threshold) == MAX_TABLES:
        k -= 1
    return k, tables_for(d, k, threshold)


def _bucket_lists(distinct: DataFrame, plan: dict[int, tuple[int, int]]) -> DataFrame:
    """``(rep, bucket)``: a row for each bucket of each distinct vector; ``plan`` gives functions and tables by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sizes = np.array([len(v) for v in batch.column("embedding")])
                for d in np.unique(sizes):
                    if int(d) not in plan:
                        continue
                    part = batch.filter(pa.array(sizes == d))
                    x, (functions, tables) = unit(matrix(part.column("embedding"))), plan[int(d)]
                    buckets = np.concatenate([table_buckets(x, t, functions) for t in range(tables)], axis=1)
                    n, r = buckets.shape
                    yield pa.RecordBatch.from_pydict({"rep": part.column("rep").take(pa.array(np.repeat(np.arange(n), r))), "bucket": pa.array(buckets.ravel())})

    return distinct.select("rep", "embedding").mapInArrow(run, "rep long, bucket long")


def _verify(x: np.ndarray, side: np.ndarray | None, lists: np.ndarray, bucket: int, copies: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of one pair of blocks: the count of each vector, and the first vector of its cluster.

    Strips of rows are compared with all later ones, so what is held is bounded by the size of the blocks, not of their links.
    """
    n = len(x)
    links, root = np.zeros(n, dtype=np.int64), np.arange(n)
    for top in range(0, n, STRIP):
        near = np.triu(x[top : top + STRIP] @ x[top:].T >= threshold, 1)
        if side is not None:
            near &= side[top : top + STRIP, None] != side[None, top:]
        i, j = np.nonzero(near)
        i, j = i + top, j + top
        keep = np.empty(len(i), dtype=bool)
        for a in range(0, len(i), 4096):  # the pair is this bucket's if it shares no smaller one
            u, v = lists[i[a : a + 4096]], lists[j[a : a + 4096]]
            shared = (u[:, :, None] == v[:, None, :]).any(axis=2)
            keep[a : a + 4096] = np.where(shared, u, np.iinfo(np.int64).max).min(axis=1) == bucket
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        while True:
            low, new = np.minimum(root[i], root[j]), root.copy()
            for at in (i, j, root[i], root[j]):
                np.minimum.at(new, at, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
    return links, root


def linked_blocks(occ: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, n)``: vector a has n links found in one pair of blocks, and is in one component with b.

    ``occ`` has a row per vector and bucket: ``(bucket, n_blocks, rep, copies, embedding, buckets)``.
    """
    blocks = F.col("n_blocks")
    occ = occ.withColumn("side", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    occ = occ.withColumn("lo", F.least("side", "_other")).withColumn("hi", F.greatest("side", "_other"))

    def work(group: pa.Table) -> dict[str, list] | None:
        if len(group) < 2:
            return None
        column = lambda c: group.column(c).combine_chunks()
        lo, hi, bucket = (group.column(c)[0].as_py() for c in ("lo", "hi", "bucket"))
        length = np.diff(column("buckets").offsets.to_numpy())
        lists = np.full((len(group), length.max()), -1, dtype=np.int64)
        lists[np.arange(length.max()) < length[:, None]] = column("buckets").flatten().to_numpy()
        empty = np.arange(length.max()) >= length[:, None]
        lists[empty] = -2 - np.broadcast_to(np.arange(len(group))[:, None], lists.shape)[empty]  # fill-ins are equal to nothing
        rep, side = column("rep").to_numpy(), column("side").to_numpy() if lo != hi else None
        links, root = _verify(unit(matrix(column("embedding"))), side, lists, bucket, column("copies").to_numpy(), threshold)
        hit = np.flatnonzero(links)
        return {"a": pa.array(rep[hit]), "b": pa.array(rep[root[hit]]), "n": pa.array(links[hit])} if len(hit) else None

    return map_groups(occ.select("bucket", "lo", "hi", "side", "rep", "copies", "embedding", "buckets"), ["bucket", "lo", "hi"], work, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, embedding)``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    ok = usable() & F.col("vec_id").isNotNull()
    same = F.when(ok, F.concat(F.hex(F.xxhash64("embedding")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "embedding"))))
    keyed = rows.withColumn("key", same)
    distinct = stored(keyed.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")), "distinct")
    # a row per vector length, of which a table has few; lengths of one vector have no pairs
    lengths = {r["d"]: r["count"] for r in distinct.groupBy(F.size("embedding").alias("d")).count().where("count > 1").collect()}
    lists = stored(_bucket_lists(distinct, {d: hash_plan(d, n, threshold) for d, n in lengths.items()}).distinct(), "buckets")
    size = lists.groupBy("bucket").count().where("count > 1").select("bucket", F.ceil(F.col("count") / block).cast("int").alias("n_blocks"))
    own = skew_join(lists, size, "bucket").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("bucket", "n_blocks"))).alias("own"))
    occ = distinct.join(own, "rep").select("rep", "copies", "embedding", F.col("own.bucket").alias("buckets"), F.explode("own").alias("at")).select("*", "at.*")
    found = stored(linked_blocks(occ, threshold), "links")
    links = found.groupBy("a").agg(F.sum("n").alias("n"))
    comps = connected_components(found.where("a <> b"))
    reps = distinct.select("key", "rep", "copies").join(links.withColumnRenamed("a", "rep"), "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    reps = reps.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = skew_join(keyed.select("vec_id", "key"), reps, "key", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
