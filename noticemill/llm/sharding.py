"""Sharding: contiguous shards of nearly equal bytes from global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .common import documents, id_key, original_id


def shard_by_bytes(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): contiguous doc_id ranges of nearly equal bytes.

    A document's size is the UTF-8 bytes of its text plus one (null: none, so one).  Documents stand in the order of
    doc_id, then checksum and size.  The shard is the one whose equal share of all bytes holds the middle byte of the
    document, so that a shard differs from its share by less than its largest document.  Slots count from 0 in the
    shard's order.  Null ids stand last; repeated rows each get a slot of their own; an empty table gives no rows.

    Sizes are sorted by range, each range's total is summed, and the running totals of the ranges (a row each, their
    number is the number of shuffle partitions) are the starting points for one pass over each range.
    """
    sizes = docs.select(
        id_key().alias("key_"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = cut(sizes.withColumn("tie", F.monotonically_increasing_id()))
    order = ["key_", "text_crc32", "size", "tie"]
    ranged = cut(
        numbered.repartitionByRange(ranges, *order)
        .sortWithinPartitions(*order)
        .withColumn("range", F.spark_partition_id())
    )
    totals = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before: dict[int, tuple[int, int]] = {}
    n_bytes = n_rows = 0
    for r in sorted(totals.collect()):
        before[r["range"]] = (n_bytes, n_rows)
        n_bytes, n_rows = n_bytes + r["bytes"], n_rows + r["rows"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[int, tuple[int, int]] = {}
        for batch in batches:
            size, part = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 4))
            start, row = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for p in np.unique(part).tolist():
                own = np.flatnonzero(part == p)
                byte, count = at.get(p, before[p])
                ends = byte + np.cumsum(size[own])
                start[own], row[own] = ends - size[own], count + np.arange(len(own))
                at[p] = int(ends[-1]), count + len(own)
            # in whole numbers: (2 * start + size) / 2 * n_shards / n_bytes
            shard = ((2 * start + size).astype(object) * n_shards // (2 * n_bytes)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(shard), pa.array(row)],
                names=["key_", "size", "text_crc32", "shard", "row"],
            )

    placed = ranged.mapInArrow(place, "key_ long, size long, text_crc32 long, shard int, row long")
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))  # n_shards rows
    return placed.join(F.broadcast(firsts), "shard").select(
        original_id("key_").alias("doc_id"),
        "size",
        "text_crc32",
        "shard",
        (F.col("row") - F.col("first")).alias("slot"),
    )


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_by_bytes(documents(spark, folder), 16).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
