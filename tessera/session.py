"""Session settings and shared-folder helpers."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. Only a local master, whose tasks see the driver's folders, may do without."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        current = sc._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="tessera-checkpoints-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where


CONSTRAINTS = "spark.sql.constraintPropagation.enabled"


def cut(df):
    """Cut lineage with a reliable checkpoint in the shared folder.

    The plan is optimised first; then constraints are switched off for the checkpoint alone, as it
    would derive them anew from the output columns, which never ends for long expressions.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    df._jdf.queryExecution().executedPlan()
    before = spark.conf.get(CONSTRAINTS)
    spark.conf.set(CONSTRAINTS, "false")
    try:
        return df.checkpoint()
    finally:
        spark.conf.set(CONSTRAINTS, before)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark can write."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df):
    """Cut lineage with a table in the shared folder, smaller than a checkpoint; and a call to drop it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path), lambda: remove(spark, path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, unless their PYTHONPATH already reaches it."""
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if str(ROOT) in paths or getattr(sc, "_tessera_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="tessera-package-")) / "tessera_package.zip"
    atexit.register(shutil.rmtree, archive.parent, ignore_errors=True)
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((ROOT / "tessera").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(archive))
    sc._tessera_shipped = True
