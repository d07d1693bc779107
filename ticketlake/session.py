"""Sessions for tests and benchmarks, and the shared folder for written tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache
from typing import Any

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_RUN = uuid.uuid4().hex


def local_session(cpus: int | str = 8, app: str = "ticketlake") -> SparkSession:
    """A single-machine session for tests and bench.py; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _local_dir() -> str:
    """A folder of this machine for a local-mode session, gone when the process ends."""
    base = tempfile.mkdtemp(prefix="ticketlake-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting falls back to a folder of this machine.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by the cluster")
        base = _local_dir()
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A folder name under the shared folder that no other job has used."""
    return f"{shared_dir(spark)}/ticketlake/{_RUN}/{name}-{uuid.uuid4().hex}"


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder; none if there is no such folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in store.listStatus(place)) if store.exists(place) else []


def drop_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


_KEPT: dict[tuple, Any] = {}


def kept(spark: SparkSession, name: str, *of: str, make: Callable[[], Any]) -> Any:
    """What ``make`` wrote, made once for a session, ``name`` and what it is ``of``, until ``release``."""
    key = (spark.sparkContext.applicationId, name, *of)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def drop_written(df) -> None:
    """Drop a table that ``cut_lineage`` wrote and nothing reads any more."""
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        drop_folder(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Drop every table that this process wrote below the shared folder.

    Results are read from these tables, so call it when they have been used or written elsewhere.
    """
    _KEPT.clear()
    drop_folder(spark, f"{shared_dir(spark)}/ticketlake/{_RUN}")


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def rows_per_file(spark: SparkSession, n: int):
    """Files that are written meanwhile hold at most ``n`` rows."""
    return _setting(spark, "spark.sql.files.maxRecordsPerFile", str(n))


def shuffles_dropped(spark: SparkSession):
    """What a write meanwhile shuffles goes from the executors' disks when it is done, not when the driver next collects garbage."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def cut_lineage(df, name: str):
    """Write ``df`` once and read it back, so later steps do not recompute it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
