"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; in local mode without one, a folder of this process.

    A cluster that names no folder is an error: a machine-local folder would lose files with its executor.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        path = tempfile.mkdtemp(prefix="tidelog-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own[app] = "file://" + path
    return _own[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_made: list[str] = []


def made() -> int:
    """How many intermediate tables this process has written so far, for release()."""
    return len(_made)


def release(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Delete the intermediate tables written since made() gave `since`, but those that `keep` reads: call it once `keep` is a written table."""
    used = " ".join(keep.inputFiles())
    for path in _made[since:]:
        if path.rpartition("/")[2] not in used:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    del _made[since:]


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: a short lineage that survives lost executors."""
    spark = df.sparkSession
    ship(spark)
    path = new_path(spark, label)
    _made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that their Python need not find it on a path of its own."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    folder = tempfile.mkdtemp(prefix="tidelog-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    root = Path(__file__).resolve().parent
    with zipfile.ZipFile(f"{folder}/tidelog.zip", "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(f"{folder}/tidelog.zip")
