"""Written cut points in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where the session names none, a
    new one is made and set, but only on a single machine; else it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir names no shared folder")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The written table ends the lineage: a lost executor costs a re-read and
    not a recomputation, and a frame that is used twice is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spent(*tables: DataFrame) -> None:
    """Delete the files of written cut points that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        top = shared_folder(spark).split(":", 1)[-1].lstrip("/")
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if folder.split(":", 1)[-1].lstrip("/").startswith(top + "/"):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """A database of its own in the shared folder, for tables that are spent
    before the result is read; ``close`` deletes their files."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name = spark, f"{name}_{uuid.uuid4().hex}"
        spark.sql(f"CREATE DATABASE {self.name} LOCATION '{shared_folder(spark)}/{self.name}'")

    def sorted_run(self, df: DataFrame, by: list[str]) -> str:
        """``df`` written in buckets of the hash of ``by``, each sorted by it: joins
        and groupings by these columns then need no shuffle. Returns the name."""
        table = f"{self.name}.run_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(buckets, *by).sortBy(*by).format("parquet").saveAsTable(table)
        return table

    def parts(self, df: DataFrame, by: str) -> DataFrame:
        """``df`` written with a folder for each value of ``by``."""
        table = f"{self.name}.parts_{uuid.uuid4().hex}"
        df.write.partitionBy(by).format("parquet").option("compression", "zstd").saveAsTable(table)
        return self.spark.table(table)

    def drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE {table}")

    def close(self) -> None:
        self.spark.sql(f"DROP DATABASE {self.name} CASCADE")
