"""What every operator needs from the session: shared storage for cut lineage, and this package on the workers."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent
#: The session's setting that an execution's shuffle files are deleted with its end.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers of the session's cluster, once per context; keep Arrow batches small."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) in (None, "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")  # rows may hold long texts
    if getattr(sc, "_quillon_shipped", False):
        return spark
    path = os.path.join(tempfile.mkdtemp(), "quillon_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(_ROOT.rglob("*.py")):
            z.write(f, str(f.relative_to(_ROOT.parent)))
    sc.addPyFile(path)
    sc._quillon_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets one of our own.

    A cluster's executors would each write to their own disk there, so without that setting it is refused.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"/tmp/checkpoints/quillon-{uuid.uuid4().hex}"
        sc.setCheckpointDir(named)
        atexit.register(shutil.rmtree, named, ignore_errors=True)  # ours, and only of a session without a cluster's folder
    return named.rstrip("/")


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """`df` written once to the shared folder and read back: lineage ends here, and lost executors cost nothing upstream.

    What the write has shuffled is deleted with its end; else it stays on the executors' disks until the driver collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._quillon_path = path
    return back


def forget(*tables: DataFrame | None) -> None:
    """Delete what `cut` has written for these tables; nothing that is still to be read may depend on them."""
    for df in tables:
        path = getattr(df, "_quillon_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
