"""Working folders and lineage cuts.

A stage is a Parquet table in a folder that driver and executors share. Compared with an in-memory cache it survives the
loss of executors, and compared with ``checkpoint()`` it keeps column pruning and statistics for the readers of the stage.

The folder is the one that ``spark.checkpoint.dir`` names; where that is unset (tests), a folder beside the warehouse, which
is shared as well. No session setting is changed.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.conf.get("spark.sql.warehouse.dir") + "/_work"
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/stages/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, folder: "WorkFolder" = None) -> DataFrame:
    """Write ``df`` once and return a reader of the written table. A ``folder`` owns the table and can remove it."""
    path = folder.path(name) if folder else scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class WorkFolder:
    """The stages of one run, removed together once the run has written its results.

    >>> with WorkFolder(spark) as work:
    ...     process_documents(documents, suppliers, as_of, work=work).documents.write.parquet(target)
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = scratch_path(spark, "run")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex}"

    def remove(self):
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.root)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.remove()
