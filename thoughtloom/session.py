"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCRATCH_PREFIX = "/tmp/spark-"


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a ``local[*]`` session may fall back to a scratch folder; on a
    cluster a missing setting is an error rather than a machine-local path.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not _is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    scratch = tempfile.mkdtemp(prefix=_SCRATCH_PREFIX)
    spark.sparkContext.setCheckpointDir(scratch)
    return scratch


def materialise(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts lineage, survives lost executors, and gives later stages pruned
    columnar reads and real sizes to plan joins with.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/frame-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a frame that ``materialise`` made."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def build_session(master: str = "local[*]", partitions: int = 8, app: str = "thoughtloom") -> SparkSession:
    """A session with the settings the jobs are designed for.

    On a cluster only the partition count and memory change: AQE coalesces
    small shuffle partitions and splits skewed join partitions at run time.
    """
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
