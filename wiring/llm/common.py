"""What the corpus operators share: table access, scratch tables and small helpers."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

from wiring.functions.scratch import scratch_path, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks that were running on it, not the steps before.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``materialise`` that no later step reads; any other table is an error."""
    spark = df.sparkSession
    own = urlsplit(f"{shared_dir(spark)}/wiring/").path
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    if not all(urlsplit(folder).path.startswith(own) for folder in folders):
        raise ValueError(f"not scratch tables: {sorted(folders)}")
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
