"""Session helpers: a local session for tests, the shared folder, and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "veriloom", cores: int | str | None = None) -> SparkSession:
    """A session with the engine's defaults. On a cluster the caller's session is used as it is."""
    master = os.environ.get("SPARK_MASTER", f"local[{cores or os.environ.get('BENCH_CPUS', '8')}]")
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.speculation", "false")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers through Spark, once a session, where their path does not have it already."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in known or spark.sparkContext.applicationId in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="veriloom-package-")  # read by this process only; Spark's file server sends it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "veriloom"), "zip", root, "veriloom"))
    _SHIPPED.add(spark.sparkContext.applicationId)


_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. On one machine, where it is unset, a temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    base = spark.conf.get("spark.veriloom.localDir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="veriloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        spark.conf.set("spark.veriloom.localDir", base)
    return base


def written(path: str) -> str:
    """The path, noted for release; what is left when the process ends is deleted then."""
    if not _WRITTEN:
        atexit.unregister(_at_exit)
        atexit.register(_at_exit)
    _WRITTEN.append(path)
    return path


def _at_exit() -> None:
    gateway = SparkContext._gateway
    try:
        conf = gateway.jvm.org.apache.hadoop.conf.Configuration()
        while _WRITTEN:
            path = gateway.jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
            path.getFileSystem(conf).delete(path, True)
    except Exception:  # noqa: BLE001
        pass  # the JVM is gone; whoever owns the shared folder has to clear it


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut, and a lost executor loses nothing.

    The table stays until release; results that are not yet computed may still read it.
    """
    spark = df.sparkSession
    path = written(f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """(materialise(df), its number of rows), counted while it is written."""
    seen = Observation()
    out = materialise(df.observe(seen, F.count(F.lit(1)).alias("n")), tag)
    n = seen.get.get("n")  # of an empty plan nothing is observed
    return out, out.count() if n is None else n


def release(spark: SparkSession) -> int:
    """Delete all tables that this process has materialised; their number. Only for when their results are written."""
    hadoop, n = spark._jsc.hadoopConfiguration(), 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += path.getFileSystem(hadoop).delete(path, True)
    return n
