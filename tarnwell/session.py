"""Session factory and the shared folder for written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with the library's settings; on a cluster the master and the sizes come from spark-submit."""
    builder = SparkSession.builder.appName("tarnwell").config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session has none and is local (tests, a laptop) is a temporary
    folder set; on a cluster that would split tables over the executors' disks.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tarnwell-checkpoint-"))
    return context.getCheckpointDir().rstrip("/")


#: Tables and stream states written so far and not yet released.
WRITTEN: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Removes what queries of this process have written in the shared folder; results that read it must have been used."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    while WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, lineage cut."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: So few rows are not worth a shuffle.
FEW = 5000


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df, its rows dealt out by a key of many values if its own partitions would leave cores idle.

    A Parquet row group is read by one task, however large it is.  Rows are counted by partition
    first, which for a table as read takes the files' footers alone; where one holds more than
    twice its share, what follows the reading is done by three tasks a core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    return df.repartition(3 * cores, key) if sum(held) > FEW and max(held) * cores > 2 * sum(held) else df
