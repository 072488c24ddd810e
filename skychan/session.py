"""Session helpers: a local session for tests/bench and the shared work folder."""
from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: The setting that drops a query's shuffle files at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "*", partitions: int = 8, app: str = "skychan") -> SparkSession:
    """Session for tests and the bench. On a cluster, build the session there."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SKYCHAN_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session; only when it is unset (local runs, tests) a fresh
    local folder is made and registered, so that ``checkpoint()`` works too.
    """
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="skychan-ckpt-")
        spark.sparkContext.setCheckpointDir(root)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/skychan-work/{name}-{uuid.uuid4().hex[:12]}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder made under ``work_path`` whose rows are stored elsewhere."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run meanwhile go when these end, not when the driver happens to collect its garbage."""
    held = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if held is None else spark.conf.set(SHUFFLE_CLEANUP, held)


def ship(spark: SparkSession) -> None:
    """Give the executors this package: the functions that run there import it."""
    sc = spark.sparkContext
    if getattr(sc, "_skychan_shipped", None) != os.getpid():
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        made = os.path.join(tempfile.mkdtemp(prefix="skychan-package-"), "skychan-package.zip")
        with zipfile.ZipFile(made, "w") as z:
            for folder, _, files in os.walk(os.path.join(top, "skychan")):
                for f in files:
                    if f.endswith(".py"):
                        z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), top))
        sc.addPyFile(made)
        sc._skychan_shipped = os.getpid()
