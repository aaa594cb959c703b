"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "redolent", cpus: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine is tuned for; on a cluster spark-submit sets master and sizes."""
    return (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("REDOLENT_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: What this process has written and not deleted yet, by session, and the folder of sessions on one machine that name none.
_WRITTEN: dict[str, list[str]] = {}
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir of the session or its configuration.

    Where that is unset a session on one machine (master local, as in tests) gets a folder of its own; a cluster is refused,
    as no folder of the driver's machine can be reached by its executors."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    if not re.fullmatch(r"local(-cluster)?(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="redolent-")
        atexit.register(shutil.rmtree, _LOCAL[app][7:], ignore_errors=True)
    return _LOCAL[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for an intermediate table or file, remembered for sweep()."""
    path = f"{shared_dir(spark)}/redolent-{name}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet into the shared folder and read it back.

    Cuts the lineage with a copy that outlives lost executors, lets later steps prune columns, and keeps a table
    that several branches read from being computed once for each.
    """
    path = scratch(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> int:
    """Delete the intermediate tables written so far, once no DataFrame that reads them is needed; how many there were."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slots(spark: SparkSession) -> int:
    """Cores the cluster offers at the moment, at least 2."""
    return max(2, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, per_slot: int = 2) -> DataFrame:
    """Deal rows over enough tasks for CPU-heavy Python steps, only where the scan gives fewer than the cluster has cores.

    A scan of many files has enough splits of its own and is left alone, so no shuffle is added at scale.
    """
    least = slots(df.sparkSession)
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least * per_slot)


def ship(spark: SparkSession) -> None:
    """Make the package importable in the Python workers: the driver serves it to every executor, once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_redolent_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="redolent-code-")) / "redolent.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._redolent_shipped = True
