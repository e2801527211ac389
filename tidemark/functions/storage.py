"""Scratch storage that the whole cluster shares, and cutting lineage in it."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.  Only a local session, which has no other machines, may go without one."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for this run, which the session deletes when it ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tidemark-{name}-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return path.toString()


def ship(spark: SparkSession, root: Path, *names: str) -> None:
    """Hand Python code under ``root`` to the session's workers, on whatever machine they start: an archive in the shared folder, made once.

    ``names`` are packages, with all their modules, and single files; those that are not there are left out.  Python that Spark
    starts beside the driver, for data sources and streams, reads no archives: it gets ``root`` by its path.
    """
    context, done = spark.sparkContext, (root, names)
    if done in getattr(context, "_tidemark_shipped", ()):
        return
    paths = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    context.environment["PYTHONPATH"] = os.pathsep.join([str(root), *(p for p in paths if p != str(root))])
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(f for n in names for f in ((root / n).rglob("*.py") if (root / n).is_dir() else root.glob(n))):
            archive.write(file, file.relative_to(root))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch(spark, 'code')}/code-{uuid.uuid4().hex}.zip")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = files.create(path)
    stream.write(bytearray(buffer.getvalue()))
    stream.close()
    context.addPyFile(files.makeQualified(path).toString())
    context._tidemark_shipped = (*getattr(context, "_tidemark_shipped", ()), done)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back.  The session's own folder of checkpoints is deleted when it ends."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    own = context.getCheckpointDir()  # a folder that Spark makes for this session alone
    if getattr(context, "_tidemark_checkpoints", None) != own:
        path = context._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
        context._tidemark_checkpoints = own
    return df.checkpoint()
