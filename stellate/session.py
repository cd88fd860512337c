"""Session helpers: the shared folder and lineage cuts."""

from __future__ import annotations

import atexit
import pathlib
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where none is
    set. On a cluster a folder of the driver would be no use to the executors, so that the setting is required."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="stellate-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = "file://" + own
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


_OPEN: list[list[str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_root(df.sparkSession)
    out = df.checkpoint(eager=True)
    if _OPEN:
        file = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            _OPEN[-1].append(file.get())
    return out


def remove_path(spark: SparkSession, path: str) -> None:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


@contextmanager
def scratch(spark: SparkSession):
    """Removes in the end the shared tables and cuts that were made inside. For work whose result is written to a path of before:
    what was made inside can't be read afterwards."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            remove_path(spark, path)


@contextmanager
def settings(spark: SparkSession, **conf: str):
    """Settings of the session for a while; a name's dots are written as two underscores."""
    keys = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut_as_laid(df: DataFrame) -> DataFrame:
    """A cut that keeps the partitioning and order of the rows known to later plans, so that joins and aggregations by the same
    keys need no exchange. The plan isn't adapted at run time, which would hide both."""
    with settings(df.sparkSession, spark__sql__adaptive__enabled="false"):
        return cut(df.select("*"))


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, for clusters where it isn't installed: as a zip that Spark adds to their path."""
    package = pathlib.Path(__file__).resolve().parent
    at = pathlib.Path(tempfile.mkdtemp(prefix="stellate-"))  # on the driver, from where Spark serves it
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(str(at / "stellate"), "zip", package.parent, package.name))
