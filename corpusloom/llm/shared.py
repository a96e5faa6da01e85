"""Places and sizes that operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and all runs on this machine, as in tests, a
    temporary one is set; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: lineage ends there, and a lost executor loses nothing of it."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Documents, and rows of a few numbers, that a stored file should hold.
FILE_DOCUMENTS, FILE_ROWS = 2048, 50_000


def gathered(df: DataFrame, n: int) -> DataFrame:
    """The frame in n partitions at most, or as many as there are cores if that is more. For each file that is written, Hadoop's local
    file system starts several processes, which at first are copies of the executor; small tables needn't be in hundreds of files."""
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism, n))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame, column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
