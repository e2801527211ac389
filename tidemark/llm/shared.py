"""Helpers that several training-data operators use: tables, shared scratch storage, skew-safe chunking."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as every contract of this package reads it: blank, tab, newline, vertical tab, form feed, return.
BLANKS = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Only a local session, as in tests, may go without one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    known = getattr(spark, "_tidemark_scratch", None)
    if known is None:
        known = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark._tidemark_scratch = known
    return known


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut and a lost executor costs nothing.

    The session deletes the table when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    # shuffle files go once the plans that made them are collected; without this they pile up until the driver's heap is full
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def text_chunks(batches: Iterator[pa.RecordBatch], max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the ``text`` of each holds about ``max_bytes`` at most; a longer single text stays whole."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(size) // max_bytes).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, which gives free memory back to the system when its task is through.

    Spark keeps idle Python workers for the next task, and what their allocators hold stands beside later stages.
    """

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of numpy and Python; only glibc has it
        if trim:
            trim(0)

    return through


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join on ``key`` in a shape whose hot partitions adaptive execution can split.

    It splits a join only if both sides were shuffled for that join.  An aggregated side comes partitioned by ``key``
    already, so a second join key, derived from the first, asks for a shuffle of its (small) result.
    """
    tag = F.pmod(F.xxhash64(key), F.lit(1 << 20))
    return left.withColumn("_tag", tag).join(right.withColumn("_tag", tag), [key, "_tag"], how).drop("_tag")


def map_groups(df: DataFrame, keys: list[str], work: Callable[[pa.Table], dict[str, list] | None], schema: str) -> DataFrame:
    """Run ``work`` on every group of equal integer ``keys``; groups must be of bounded size.

    One shuffle and sort; a task streams its groups, so it holds one batch and one group at a time, and many small
    groups cost no call into Python each.
    """
    n = partitions(df.sparkSession)

    def cuts(t: pa.RecordBatch | pa.Table) -> list[int]:
        columns = [t.column(k).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(k).to_numpy() for k in keys]
        return (np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def results() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            edges = [0, *cuts(whole), len(whole)]
            for a, b in zip(edges, edges[1:]):
                out = work(whole.slice(a, b - a))
                if out is not None:
                    yield pa.RecordBatch.from_pydict(out)

        for batch in batches:
            if not batch.num_rows:
                continue
            ends = cuts(batch)
            if held:  # the group that is held may go on here
                goes_on = all(held[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in keys)
                stop = (ends[0] if ends else batch.num_rows) if goes_on else 0
                held.append(batch.slice(0, stop))
                if stop == batch.num_rows:
                    continue
                yield from results()
                batch, ends = batch.slice(stop), [e - stop for e in ends if e > stop]
            if ends:
                held.append(batch.slice(0, ends[-1]))
                yield from results()
                batch = batch.slice(ends[-1])
            held.append(batch)
        if held:
            yield from results()

    return df.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(lean(run), schema)
