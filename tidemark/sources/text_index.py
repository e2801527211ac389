"""Finding texts that hold a needle without reading all files: for every three letters the files in which they stand."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.select import matching


#: A task hands on what it has found once it holds so many runs.
HELD = 500_000


def grams(text: str) -> set[str]:
    """The distinct runs of three letters of a text."""
    return {text[i : i + 3] for i in range(len(text) - 2)}


def _grams_of_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, set[str]] = {}

    def found():
        for file, some in held.items():
            yield pa.RecordBatch.from_pydict({"file": pa.repeat(file, len(some)), "gram": pa.array(some, pa.string())})
        held.clear()

    for batch in batches:
        for file, text in zip(batch.column("file").to_pylist(), batch.column("text")):
            held.setdefault(file, set()).update(grams(text.as_py()))
        if sum(map(len, held.values())) > HELD:
            yield from found()
    yield from found()


def write_indexed(df: DataFrame, column: str, path: str, files: int | None = None, order: tuple[str, ...] = ()) -> None:
    """Writes ``df`` under ``path`` and beside it ``(gram, file)`` for its text ``column``, in order of grams.

    Rows are dealt by ranges of ``order`` (the column itself, if none is named), so that texts that begin alike share files.  The
    index has one row for each file and gram in it; a task gathers the grams of its files as it reads them, so about as many are
    shuffled.  Texts are read as they are, nulls and texts of less than three letters give none.
    """
    spark = df.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(files, *(order or (column,))).write.mode("overwrite").parquet(f"{path}/rows")
    rows = spark.read.schema(df.schema).parquet(f"{path}/rows")
    texts = rows.select(F.col("_metadata.file_name").alias("file"), F.lower(F.col(column).cast("string")).alias("text")).where("text IS NOT NULL")
    found = texts.mapInArrow(_grams_of_files, "file string, gram string").distinct()
    found.repartitionByRange("gram", "file").sortWithinPartitions("gram", "file").write.mode("overwrite").parquet(f"{path}/grams")


def files_that_may_hold(spark: SparkSession, path: str, needle: str) -> DataFrame | None:
    """``(file)``: those that hold every gram of the needle; None where the needle is too short to tell.

    The grams reach the reader of the index as a filter, and as it is in their order, few of its row groups are read.
    """
    wanted = sorted(grams(spark.range(1).select(F.lower(F.lit(needle)).alias("n")).first()["n"]))
    if not wanted:
        return None
    index = spark.read.schema("file string, gram string").parquet(f"{path}/grams")
    return index.where(F.col("gram").isin(wanted)).groupBy("file").count().where(F.col("count") == len(wanted)).select("file")


def search(spark: SparkSession, path: str, column: str, needle: str, schema=None) -> DataFrame:
    """The rows whose text holds the needle, letters compared without case: as ``select.matching``, which checks every row read.

    Only files that may hold it are opened.  Their names come to the driver, which lists the files of any scan anyway.  Needles of
    less than three letters read all files.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    some = files_that_may_hold(spark, path, needle)
    if some is None:
        return matching(reader.parquet(f"{path}/rows"), column, needle)
    names = [f"{path}/rows/{r['file']}" for r in some.collect()]
    if not names:
        return reader.parquet(f"{path}/rows").where(F.lit(False))
    return matching(reader.parquet(*names), column, needle)
