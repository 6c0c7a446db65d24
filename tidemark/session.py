"""Sessions, tables and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and benchmarks. On a cluster, use the session it gives."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


class Tables:
    """``Tables(spark, folder).orders`` reads ``folder/orders.parquet``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")

    @property
    def spark(self) -> SparkSession:
        return self._spark


def _shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. One of our own where it is unset and all of Spark is this process; on a cluster that is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(folder)
    return (spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the folder that spark.checkpoint.dir names."""
    _shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in that folder, which goes when the session's file system closes.

    For loops that join their own results: a checkpoint keeps the estimated size of its plan, and as that of a join is the
    product of both, the numbers' digits double each round until planning takes all the time. A table has its files' size.
    """
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{_shared_dir(spark)}/stored-{uuid.uuid4().hex}")
    df.write.parquet(path.toString())
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(path.toString())
