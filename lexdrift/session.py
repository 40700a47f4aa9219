"""Session defaults and the one way to cut lineage: a table in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "lexdrift", memory: str = "12g") -> SparkSession:
    """A session for one machine; on a cluster use the one that is there."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_staged: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only on one machine, where none is set, one of our own (tests).

    On a cluster a folder that all machines share must be named; a local one would lose staged tables.
    """
    own = spark.conf.get("spark.checkpoint.dir", "")
    if own:
        return own
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    path = tempfile.mkdtemp(prefix="lexdrift-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir() or path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The result no longer depends on its inputs, all executors see it, and a lost executor loses
    nothing. The files are removed when the driver's interpreter ends, or by ``drop_staged`` before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lexdrift-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    if not _staged:
        atexit.register(lambda: drop_staged(spark))
    _staged.append(path)
    return spark.read.schema(schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Remove all tables staged so far; results that are still to be read from them must be written first."""
    while _staged:
        _remove(spark, _staged.pop())


def _remove(spark: SparkSession, path: str) -> None:
    try:
        sc = spark.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone already
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
