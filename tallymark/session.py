"""Session settings and the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDER_KEY = "spark.checkpoint.dir"
#: Folders that this process has written with :func:`stored`.
_STORED: list[str] = []


def build_session(app: str = "tallymark", master: str | None = None,
                  shuffle_partitions: int | None = None,
                  driver_memory: str | None = None) -> SparkSession:
    """A session with adaptive execution on; skewed joins are split at run time."""
    builder = (SparkSession.builder.appName(app)
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.python.sql.dataFrameDebugging.enabled", "false"))
    if master:
        builder = builder.master(master)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where the driver has it, whatever folder it runs in."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def shared_folder(spark: SparkSession) -> str:
    """A fresh path under the shared folder named by ``spark.checkpoint.dir``.

    Only where the cluster names none (a local test) does a temporary folder take its place.
    """
    root = spark.conf.get(_FOLDER_KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{_FOLDER_KEY} must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tallymark-")
        spark.conf.set(_FOLDER_KEY, root)
    return os.path.join(root, uuid.uuid4().hex)


def stored(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read back.

    Its size is then known before the next step is planned: a small result is broadcast by the
    optimizer's own size check, a large one is joined by shuffle. It also survives lost executors.
    """
    folder = shared_folder(df.sparkSession)
    _STORED.append(folder)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes a folder in whatever file system it lies; one that is not there is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard_stored(spark: SparkSession) -> int:
    """Deletes all that :func:`stored` has written in this process; returns the number of folders.

    To be called when no frame that reads them is needed any more, such as after a result is written.
    """
    gone = len(_STORED)
    while _STORED:
        discard(spark, _STORED.pop())
    return gone
