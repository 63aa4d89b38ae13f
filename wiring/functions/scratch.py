"""The folder for intermediate files that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset (tests, local mode) a temporary folder is made and kept for the session.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="wiring-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/wiring/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: what follows reads its rows and does not compute them again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that no later step reads; any other table is an error."""
    spark = df.sparkSession
    own = urlsplit(f"{shared_dir(spark)}/wiring/").path
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    if not all(urlsplit(folder).path.startswith(own) for folder in folders):
        raise ValueError(f"not scratch tables: {sorted(folders)}")
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


#: Rows of a few numbers that a task sorts and counts in a few hundred MB.
TASK_ROWS = 500_000


def parts_for(spark: SparkSession, rows: int) -> int:
    """So many partitions that a task's rows do not grow with the table."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
