"""Spark session helpers.

The library never creates its own session inside an operator: every operator
takes DataFrames.  These helpers exist for tests, the bench and the entry
module, and for the one piece of cluster plumbing operators need: the shared
checkpoint folder used to cut long lineages.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "shipcast") -> SparkSession:
    """Local session for tests and the bench (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting is supplied by the deployment and points at
    shared storage; without it a cluster session is refused.  Only a local
    session (tests), where one machine runs everything, gets a folder here.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="shipcast-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_table(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to a fresh folder of the shared storage and scan it.

    Unlike a checkpoint, the scan knows its size in bytes, so the planner picks
    broadcast or shuffle joins by it.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_FRESH: list[str] = []
_TABLES: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A folder of the shared storage that nothing else writes to."""
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    _FRESH.append(path)
    return path


def fresh_table(spark: SparkSession, name: str) -> tuple[str, str]:
    """A catalog name that nothing else uses, and a fresh folder for its files."""
    table = f"shipcast_{name}_{uuid.uuid4().hex}"
    _TABLES.append(table)
    return table, fresh_path(spark, name)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(hadoop).delete(path, True)


def release_tables(spark: SparkSession) -> None:
    """Delete what ``fresh_path`` gave out so far.  Frames that were returned but
    not yet consumed read those folders: call it when their results are in, or
    use ``table_scope`` for a part of a session's work."""
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    paths, _FRESH[:] = list(_FRESH), []
    _delete(spark, paths)


def drop_table(df: DataFrame) -> None:
    """Delete the folder of a ``stored_table`` whose last reader is done."""
    read = df.inputFiles()
    gone = [p for p in _FRESH if any(_below(f, p) for f in read)]
    _FRESH[:] = [p for p in _FRESH if p not in gone]
    _delete(df.sparkSession, gone)


def _below(file: str, folder: str) -> bool:
    plain = lambda x: unquote(x.split("://", 1)[-1].removeprefix("file:"))  # noqa: E731 - file:/a, file:///a and /a are one
    return plain(file).startswith(plain(folder).rstrip("/") + "/")


@contextmanager
def table_scope(spark: SparkSession):
    """Release at its end what was handed out inside, and nothing else::

        with table_scope(spark):
            query(spark, sf_dir).write.parquet(out)

    Frames made before the scope, or in another one, stay readable.
    """
    before = set(_FRESH), set(_TABLES)
    try:
        yield
    finally:
        for t in [t for t in _TABLES if t not in before[1]]:
            _TABLES.remove(t)
            spark.sql(f"DROP TABLE IF EXISTS {t}")
        mine = [p for p in _FRESH if p not in before[0]]
        _FRESH[:] = [p for p in _FRESH if p in before[0]]
        _delete(spark, mine)


JIT_METHOD_BYTES = 8000  # HotSpot interprets longer methods for ever


def prepare_session(spark: SparkSession) -> None:
    """What every query expects of its session: the package on the executors, and no
    generated method that the JVM would not compile (wide projections of the order
    features are 32 KB in one piece; beyond the limit Spark generates them in parts)."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(JIT_METHOD_BYTES))
    ship_package(spark)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors (once a context), so that their Python
    workers find it whatever folder they start in."""
    sc = spark.sparkContext
    if getattr(sc, "_shipcast_sent", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="shipcast-py-"), "shipcast.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(home):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, os.path.dirname(home)))
    sc.addPyFile(archive)
    sc._shipcast_sent = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", name) if "://" not in base else f"{base.rstrip('/')}/tables/{name}"
