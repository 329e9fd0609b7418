"""Cut long lineages into the cluster's shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark then drops the shuffle files of a query when it ends; no later step reads those of a table that is written.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BLOCK_BYTES = 2**25  # of a row group, which a task holds while it writes


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which a cluster's machines must share.

    Where the session names none, as in tests on one machine, a folder in the warehouse is set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{warehouse}/_checkpoints")
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables between the steps of one job, written in the shared folder as compressed columns.

    Unlike a checkpoint's, their files go when the job says so or ends, and the shuffle files that made a table go as
    soon as it is written.  What is read from them must be cut before the job ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[DataFrame, str] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop(*self.paths)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/{uuid.uuid4().hex}"
        before = self.spark.conf.get(DROP_SHUFFLES, None)
        self.spark.conf.set(DROP_SHUFFLES, "true")
        try:
            df.write.options(**{"compression": "zstd", "parquet.block.size": str(BLOCK_BYTES)}).parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(DROP_SHUFFLES)
            else:
                self.spark.conf.set(DROP_SHUFFLES, before)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[kept] = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        context = self.spark.sparkContext
        for name in [self.paths.pop(t) for t in tables if t in self.paths]:
            path = context._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with new columns that are computed one time for each row, however often later filters and columns use them.

    Spark copies a column's expression into every filter and column above it; a generated row is a value to them.
    """
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select("*", made)
