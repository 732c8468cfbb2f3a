"""Sessions, the shared folder, and cutting lineage so that it survives a lost executor."""

from __future__ import annotations

import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: weakref.WeakSet = weakref.WeakSet()


def build_session(app: str = "tabulara", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; conf overrides any of it."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session; only where that is unset (tests, one machine) one of our own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="tabulara-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """df written to the shared folder and read from there: short lineage, stable partitions, nothing lost with an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for a table in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Has Hadoop delete path when the application ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(table: DataFrame) -> DataFrame:
    """A stored table over at least as many partitions as there are cores: a small one may lie in fewer files than that. Larger ones stay as they are."""
    n = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(n) if table.rdd.getNumPartitions() < n else table


def ship_code(spark: SparkSession) -> None:
    """Gives the executors this package, once per session, where they don't have it on their path."""
    sc = spark.sparkContext
    if sc in _shipped:
        return
    package = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="tabulara-code-")) / "tabulara.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc)
