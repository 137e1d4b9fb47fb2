"""Session defaults and durable lineage cuts."""
from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "canopyframe") -> SparkSession:
    """A session for tests and the single-node bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Loops keep a short lineage that survives lost executors, and later joins plan with the real size.
    (A checkpointed frame would carry the constraints of its old plan, which grow with every round.)
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(*frames: DataFrame) -> None:
    """Deletes what ``cut`` wrote for each of ``frames``; call it once everything made from them is written."""
    for df in frames:
        files = df.inputFiles()
        folder = files[0].rsplit("/", 1)[0] if files else ""
        if folder.rsplit("/", 1)[-1].startswith("cut-"):
            jvm = df.sparkSession.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nobody holds any more.

    Spark does so when the driver's JVM happens to collect its garbage; with a large heap that can be long after a big shuffle was read.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
