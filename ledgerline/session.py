"""Session set-up and tables staged in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def get_session(app: str = "ledgerline", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings the operators expect. The web page stays off."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, reachable from every executor.

    Only a local session may go without the setting; it gets a fresh temporary folder.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="ledgerline-")
    spark.conf.set(CHECKPOINT_SETTING, folder)
    return folder


_OWNED: ContextVar[list[str] | None] = ContextVar("owned", default=None)  # paths of the innermost owner


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it belongs to the innermost :func:`staged_tables`."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    owned = _OWNED.get()
    if owned is not None:
        owned.append(path)
    return path


@contextmanager
def staged_tables(spark: SparkSession):
    """Owns the tables that are staged in the block and deletes them at its end, after an error too.

    Results of operators read from staged tables, so write or collect them within the block. Blocks may be nested: each
    owns what is staged directly in it. Gives the list of owned paths.
    """
    owned: list[str] = []
    token = _OWNED.set(owned)
    try:
        yield owned
    finally:
        _OWNED.reset(token)
        for path in owned:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, fixes values that depend on task layout, and keeps later passes
    columnar, so each reads only the columns it needs. A lost executor costs nothing.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_evenly(df: DataFrame, name: str) -> DataFrame:
    """:func:`stage` with the rows dealt evenly into a file for each core.

    For rows that are read many times, as by a fit: a small file of few row groups would leave all but one or two cores
    idle in each pass.
    """
    return stage(df.repartition(df.sparkSession.sparkContext.defaultParallelism), name)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings that hold while the block runs jobs."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def with_row_key(df: DataFrame, key: str = "txn_id") -> DataFrame:
    """``df`` with a unique row key, numbered and staged when it has none.

    A hash of the row would not do: copies of one row would all draw the same lot in a sample.
    Staging makes the numbers final before any shuffle depends on them.
    """
    if key in df.columns:
        return df
    return stage(df.withColumn(key, F.monotonically_increasing_id()), "keyed")
