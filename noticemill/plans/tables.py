"""Input tables and the fixed clocks of the example queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, tasks: int | None = None, by: str | None = None) -> DataFrame:
    """Rows dealt evenly over ``tasks`` (the session's shuffle partitions if not given), at every size alike.

    For columns on which each row costs much more than its way through a shuffle: a file of one row group is one task,
    and Spark joins a shuffle's small parts into few tasks.  With ``by``, rows of one value stay together, ready to be
    grouped by it where they are.
    """
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, by) if by else df.repartition(tasks)


def clock(text: str) -> Column:
    """A fixed UTC instant, independent of the session zone."""
    return F.to_timestamp(F.lit(text + "+00:00"))


def iso_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")

