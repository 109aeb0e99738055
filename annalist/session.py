"""Session-level helpers: table access, shared scratch space, lineage cuts."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One Parquet table of a data directory (a file or a directory of part files)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is ``spark.checkpoint.dir``; only where that is unset and Spark runs on this machine alone (tests) a temporary
    folder is chosen and remembered for the session.  On a cluster a missing setting is an error.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf:
        conf = getattr(spark, "_annalist_scratch", None)
        if not conf:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
            conf = tempfile.mkdtemp(prefix="annalist-")
            spark._annalist_scratch = conf
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(conf)
    return conf


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once per session, as an archive in the shared folder.

    Workers else find it only where it is installed or on their path.
    """
    if getattr(spark, "_annalist_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    p = os.path.join(folder, n)
                    z.write(p, os.path.join("annalist", os.path.relpath(p, root)))
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{scratch_path(spark, 'code')}/annalist_code.zip")
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    stream.write(bytearray(out.getvalue()))
    stream.close()
    spark.sparkContext.addPyFile(target.toString())
    spark._annalist_shipped = True


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder of this application under the shared folder; the folder goes when the driver ends."""
    root = getattr(spark, "_annalist_root", None)
    if root is None:
        root = spark._annalist_root = os.path.join(shared_dir(spark), f"annalist-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}")
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        atexit.register(_forget, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p)
    return os.path.join(root, f"{label}-{uuid.uuid4().hex}")


def _forget(store, path) -> None:
    try:
        store.delete(path, True)
    except Exception:  # the JVM is gone already
        pass


def cut(df: DataFrame, label: str = "cut", drop: DataFrame | None = None) -> DataFrame:
    """Materialise ``df`` in the shared folder and return it without its lineage.

    A written table survives the loss of executors and, unlike an RDD checkpoint, is read back columnar and
    keeps column pruning; the plan of later rounds starts at this scan.  ``drop`` is an earlier cut that ``df`` was the
    last to read; its files are deleted.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    if drop is not None and (old := getattr(drop, "_annalist_path", None)):
        drop_path(spark, old)
    out = spark.read.schema(df.schema).parquet(path)
    out._annalist_path = path
    return out


def cut_observed(df: DataFrame, label: str, figure: Column, drop: DataFrame | None = None) -> tuple[DataFrame, object]:
    """``cut``, and an aggregate over its rows that is taken while they are written."""
    seen = Observation()
    out = cut(df.observe(seen, figure.alias("n")), label, drop)
    return out, seen.get["n"]


def cut_counted(df: DataFrame, label: str = "cut", where: str = "true", drop: DataFrame | None = None) -> tuple[DataFrame, int]:
    """``cut``, and how many rows meet a condition, counted while they are written."""
    out, n = cut_observed(df, label, F.count_if(F.expr(where)), drop)
    return out, int(n or 0)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path; missing paths are ignored."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
