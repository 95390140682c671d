"""Tables that outlive a stage: written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}

#: Whether what a query shuffled is deleted when it ends. Otherwise it stays until the driver happens to collect its garbage, and a stage of many steps holds all of them at once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, in local mode (tests), a temporary one. On a cluster it must be set, as its machines share no
    other folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="ledgerlark-")
    return _own[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/ledgerlark-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read from there: later readers, and tasks that are
    run again for a lost executor, read files instead of repeating the work. What was shuffled for it goes, and so it is with later queries of the session."""
    spark = df.sparkSession
    spark.conf.set(CLEANUP, "true")
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
