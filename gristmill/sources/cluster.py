"""What a cluster needs of a session: this package on every worker, tables in a folder that all share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Let executors import this package.

    It travels as one zip through Spark's own file server, so workers need no shared code folder.
    Doing it again in the same application is free.
    """
    sc = spark.sparkContext
    if getattr(sc, "_gristmill_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="gristmill-"), "gristmill_src.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, str(path.relative_to(root.parent)))
    sc.addPyFile(target)
    sc._gristmill_shipped = True


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: one of this application in ``spark.checkpoint.dir``.

    Where the session leaves that unset, a local folder serves a session on one machine; any other
    session fails, since its executors don't share folders.  Tables stay until the driver ends or
    ``clean`` is called, since results are read from them.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not getattr(spark, "_gristmill_scratch", None):
            spark._gristmill_scratch = tempfile.mkdtemp(prefix="gristmill-scratch-")
            atexit.register(shutil.rmtree, spark._gristmill_scratch, ignore_errors=True)
        root = "file://" + spark._gristmill_scratch
    return f"{root.rstrip('/')}/gristmill/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that weren't written are lost."""
    root = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def materialize(df: DataFrame, name: str, path: str | None = None, options: dict | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder (or at ``path``) and return a scan of it.

    This cuts lineage in a way that outlives executors: a later stage rereads files instead of
    recomputing, and needs only the columns it uses.
    """
    spark = df.sparkSession
    path = path or f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
