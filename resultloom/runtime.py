"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "resultloom", **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, skew splitting)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a hot key also where what follows has to shuffle again for it.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    Only a local session that names none gets one of its own: on a cluster a
    machine-local folder would be lost with its executor.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage at a place that survives the loss of executors, and fixes
    values (such as partition numbers) that two evaluations could disagree on.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/resultloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_to = path
    return written


def _files(spark: SparkSession, path: str):
    """(file system, Hadoop path) of a path of the shared folder."""
    context = spark.sparkContext
    found = context._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(context._jsc.hadoopConfiguration()), found


def stored_once(spark: SparkSession, name: str, write: Callable[[str], None]) -> str:
    """The folder of a result that is written where it is first asked for.

    ``write`` gets a folder of its own. A folder counts once its writer has left its mark of success; of
    several, by callers at the same time, the first by name serves all later ones, so none is read
    while it is written and none is written twice over.
    """
    prefix = f"{shared_folder(spark).rstrip('/')}/resultloom/{name}"

    def complete() -> list[str]:
        system, pattern = _files(spark, f"{prefix}-*/_SUCCESS")
        return sorted(str(status.getPath().getParent()) for status in system.globStatus(pattern) or [])

    if not complete():
        write(f"{prefix}-{uuid.uuid4().hex}")
    return complete()[0]


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    system, path = _files(df.sparkSession, df.written_to)
    system.delete(path, True)
