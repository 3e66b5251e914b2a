"""Session helpers: a tuned session and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "webquire", partitions: int = 8) -> SparkSession:
    """Session for tests and benches; on a cluster use the session you are given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("WEBQUIRE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


# folders that this process has named, by application
_named: dict[str, list[str]] = {}


def _work_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master without that setting gets a folder of its own, below
    ``WEBQUIRE_WORK`` if that is set, else in the system's temporary folder.
    """
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="webquire-", dir=os.environ.get("WEBQUIRE_WORK")))
    return spark.sparkContext.getCheckpointDir()


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{_work_root(spark).rstrip('/')}/webquire/{name}-{uuid.uuid4().hex}"
    _named.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_work(spark: SparkSession) -> int:
    """Delete the folders below the shared one that this application has made so far; how many there were.

    For the end of a job: results that still read from them are lost.
    """
    paths, jvm = _named.pop(spark.sparkContext.applicationId, []), spark.sparkContext._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return sum(bool((p := jvm.org.apache.hadoop.fs.Path(path)).getFileSystem(conf).delete(p, True)) for path in paths)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the file system that Spark takes it for, without a slash at the end."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = str(place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(place)).rstrip("/")
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The copy survives the loss of executors and ends the lineage.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; unlike ``cut`` it keeps the partitions as they are."""
    root = _work_root(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)
