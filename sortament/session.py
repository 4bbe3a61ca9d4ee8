"""Session helpers: the settings the engine relies on, and tables that cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that matter to the plans. All are Spark's own keys; a cluster's values win.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "sortament", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS, overridden by ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the session's ``spark.checkpoint.dir``, which all
    executors share. Where that is unset and the master is this one process (tests) a
    temporary folder is made, once; on any other master this raises, as executors would
    each write to a disk of their own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {context.master} share")
    if context.applicationId not in _OWN_FOLDERS:
        _OWN_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="sortament-checkpoint-")
    return _OWN_FOLDERS[context.applicationId]


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as a Parquet table into the shared folder and read it.

    Unlike ``DataFrame.checkpoint`` the result has statistics, so Spark knows the size of
    what it joins, and none of the constraints of its origin, which grow with every round
    of a loop. Lost executors cost only their own tasks. The session's tables are deleted
    when its driver ends, or before by ``discard``.
    """
    spark = df.sparkSession
    path = f"{_table_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._sortament_path = path
    return table


def is_table(df: DataFrame) -> bool:
    """Whether ``df`` is a written table as ``materialise`` returns it."""
    return getattr(df, "_sortament_path", None) is not None


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing will read any more."""
    for table in tables:
        if is_table(table):
            _remove(table.sparkSession, table._sortament_path)


def _table_folder(spark: SparkSession) -> str:
    folder = f"{ensure_checkpoint_dir(spark)}/sortament-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_remove, spark, folder)
    return folder


_FOLDERS: set[str] = set()
_OWN_FOLDERS: dict[str, str] = {}  # by application


def _remove(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once per session's
    context. Spark's own file server hands it out, also to executors that join later."""
    context = spark.sparkContext
    if getattr(context, "_sortament_shipped", False):
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="sortament-")) / "sortament.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, Path(root.name) / path.relative_to(root))
    context.addPyFile(str(archive))
    context._sortament_shipped = True
