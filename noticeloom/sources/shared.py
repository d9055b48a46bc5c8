"""A folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task sorts or hashes at once where a table of any size is dealt by its keys.
ROWS = 500_000


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new name below the folder in spark.checkpoint.dir. Where that is unset, below a temporary folder if Spark runs on one machine; an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc()
        if not jsc.getCheckpointDir().isDefined():
            if spark.sparkContext.master.partition("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="noticeloom-"))
        found = jsc.getCheckpointDir().get()
    return f"{found.rstrip('/')}/noticeloom/{label}-{uuid.uuid4().hex}"


def tasks_of(df: DataFrame, rows: int = ROWS) -> int:
    """Tasks to deal a table to so that each has about so many rows at most; one a core at least. Counts the table (of Parquet files, their footers)."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
