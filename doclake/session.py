"""Session set-up and the two lineage helpers every operator shares."""

from __future__ import annotations

import contextlib
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders made since ``work_ends`` began, where it holds.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def get_session(app: str = "doclake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_with_tasks(module_name: str) -> None:
    """Send a module's functions inside the task closures, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def partition_count(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the caller sets them to fit the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cluster_by(df: DataFrame, *keys: Column | str, partitions: int | None = None) -> DataFrame:
    """Hash-distribute rows once, before they are exploded into tokens or lines.

    Later windows and aggregations whose keys start with ``keys`` reuse this distribution, so the only bytes that
    cross the network are the source texts, never their tokens. The partition count is explicit (``partitions``, else the
    session's): the rows grow by orders of magnitude after the exchange, which the adaptive coalescer cannot foresee.
    """
    return df.repartition(partitions or partition_count(df.sparkSession), *keys)


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: ``spark.checkpoint.dir``, else below the warehouse; both are shared by a cluster.

    A folder of one machine serves only a session that runs on one machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return f"{tempfile.gettempdir()}/doclake-{spark.sparkContext.applicationId}"
    if base.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base}/doclake-work"


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one."""
    return _kept(f"{shared_folder(spark)}/doclake-{name}-{uuid.uuid4().hex}")


def _kept(folder: str) -> str:
    made = _made.get()
    if made is not None:
        made.append(folder)
    return folder


def file_system(spark: SparkSession, folder: str):
    """The file system a folder lies in, whatever its scheme, and the maker of its paths."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), path


def drop_work(spark: SparkSession, folder: str) -> None:
    """Removes a table of ``work_dir``, or a part of one, that nothing reads any more."""
    fs, path = file_system(spark, folder)
    fs.delete(path(folder), True)


@contextlib.contextmanager
def work_ends(spark: SparkSession) -> Iterator[None]:
    """Tables and checkpoints that are made inside go at the end; what is read of them must be written by then."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for folder in made:
            drop_work(spark, folder)


@contextlib.contextmanager
def shuffles_end_with_steps(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is executed inside go when its execution ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint()
    if _made.get() is not None:
        _kept(out._jdf.logicalPlan().rdd().getCheckpointFile().get())
    return out
