"""Streaming form of the snapshot merge: same rules, same result as the batch job.

The stream carries control rows and record rows in one schema (``kind`` is
``control`` or ``record``).  State lives in tables under one folder, split into
buckets of sources; a micro-batch reads and rewrites only the buckets it touches,
under the batch's own version, so a repeated batch writes the same rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from ..operators.snapshots import AHEAD_SECONDS, latest_records

BUCKETS = 64


def bucket_of(source: Column) -> Column:
    return F.pmod(F.xxhash64(source), F.lit(BUCKETS)).cast("int")


def _latest(spark: SparkSession, folder: str, schema: StructType, before: int | None = None) -> DataFrame:
    """Newest version of every bucket (older than a batch, when given)."""
    parts = [StructField("bucket", IntegerType()), StructField("version", LongType())]
    with_parts = StructType([*schema.fields, *parts])
    try:
        state = spark.read.schema(with_parts).parquet(folder)
    except AnalysisException:
        return spark.createDataFrame([], with_parts)
    if before is not None:
        state = state.filter(F.col("version") < before)
    newest = state.groupBy("bucket").agg(F.max("version").alias("version"))
    return state.join(newest, ["bucket", "version"], "left_semi")


class SnapshotState:
    """Live records and the control rows they still need."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, is_index: Column) -> None:
        self.spark, self.folder, self.schema, self.is_index = spark, folder.rstrip("/"), schema, is_index

    def rows(self, before: int | None = None) -> DataFrame:
        return _latest(self.spark, f"{self.folder}/state", self.schema, before)

    def current(self) -> DataFrame:
        """Records a reader sees now."""
        return self._merge(self.rows().drop("bucket", "version"))

    def _merge(self, rows: DataFrame) -> DataFrame:
        control = rows.filter("kind = 'control'").select("source_id", "attempted_at", "status")
        records = rows.filter("kind = 'record'").drop("kind", "status")
        return latest_records(control, records, self.is_index)

    def apply(self, batch: DataFrame, batch_id: int, now: Column | None = None) -> None:
        """Merge one micro-batch. Observations too far ahead of ``now`` are dropped."""
        batch = batch.select(*self.schema.names)
        if now is not None:
            limit = F.unix_micros(now) + AHEAD_SECONDS * 1_000_000
            ahead = F.unix_micros(F.col("observed_at").cast("timestamp")) > limit
            batch = batch.filter((F.col("kind") == "control") | ~F.coalesce(ahead, F.lit(False)))
        batch = batch.withColumn("bucket", bucket_of(F.col("source_id")))
        # At most BUCKETS small integers.
        touched = [r[0] for r in batch.select("bucket").distinct().collect()]
        if not touched:
            return
        before = self.rows(batch_id).filter(F.col("bucket").isin(touched)).drop("version")
        rows = before.unionByName(batch).dropDuplicates(["kind", "source_id", "attempted_at", "identity"])
        live = self._merge(rows.drop("bucket"))
        kept_records = rows.join(
            live.select("source_id", "identity", "attempted_at"), ["source_id", "identity", "attempted_at"], "left_semi"
        )
        # Control rows: everything since the oldest live record, and the last attempts.
        oldest = live.groupBy("source_id").agg(F.min("attempted_at").alias("__oldest"))
        control = rows.filter("kind = 'control'")
        last = control.groupBy("source_id").agg(
            F.max(F.when(F.col("status") != "UNAVAILABLE", F.col("attempted_at"))).alias("__ok"),
            F.max("attempted_at").alias("__last"),
            F.max(
                F.when((F.col("status") == "SUCCESS") | ((F.col("status") == "PARTIAL") & ~self.is_index), F.col("attempted_at"))
            ).alias("__full"),
        )
        kept_control = (
            control.join(oldest, "source_id", "left")
            .join(last, "source_id", "left")
            .filter(
                (F.col("attempted_at") >= F.least("__oldest", "__ok", "__last"))
                | (F.col("attempted_at") == F.col("__full"))
            )
            .drop("__oldest", "__ok", "__last", "__full")
        )
        out = kept_control.unionByName(kept_records.select(*kept_control.columns)).withColumn(
            "version", F.lit(batch_id).cast("bigint")
        )
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(
            f"{self.folder}/state"
        )


def start_merge(stream: DataFrame, state: SnapshotState, checkpoint: str, now: Column | None = None, **trigger) -> StreamingQuery:
    """Run the merge on a stream; ``trigger`` is passed to ``writeStream.trigger``."""
    return (
        stream.writeStream.foreachBatch(lambda df, batch_id: state.apply(df, batch_id, now))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
