"""Row numbers and first/last picks that never put one hot group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunked_row_number(
    df: DataFrame, group: list[str], order: list[Column], chunk: Column, out: str = "rank"
) -> DataFrame:
    """Exact ``row_number()`` over ``group`` without sorting a whole group in one task.

    ``chunk`` is a coarse value that never decreases along ``order`` (a month of the
    ordering date, a thousand-block of an ordinal).  Rows are numbered inside
    (group, chunk); the number of earlier rows comes from per-chunk counts, which
    are combined map-side.  A group holding a third of all rows is spread over its
    chunks.
    """
    work = df.withColumn("__chunk", chunk)
    counts = work.groupBy(*group, "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
        F.col("__chunk").alias("__c"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.partitionBy(*group)).alias("__total"),
    )
    local = work.withColumn(
        "__local", F.row_number().over(Window.partitionBy(*group, "__chunk").orderBy(*order))
    )
    same = F.col("__chunk").eqNullSafe(F.col("__c"))
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    joined = local.join(offsets, same, "left")
    return joined.withColumns(
        {out: (F.col("__local") + F.col("__before")).cast("bigint"), f"{out}_of": F.col("__total")}
    ).drop("__chunk", "__local", "__c", "__before", "__total", *[f"__g{i}" for i in range(len(group))])


def top_per_group(
    df: DataFrame, group: list[str], order: list[Column], limit: int, out: str = "rank"
) -> DataFrame:
    """First ``limit`` rows per group; Spark prunes each task to ``limit`` before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= limit)


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row of each key; combines map-side, so repeats never travel."""
    rest = [c for c in df.columns if c not in keys]
    packed = df.select(
        *keys, F.struct(*order).alias("__o"), F.struct(*[F.col(c) for c in rest]).alias("__r")
    )
    return packed.groupBy(*keys).agg(F.min_by("__r", "__o").alias("__r")).select(*keys, "__r.*")


def last_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the last row of each key, at the position of its first (map-side combined)."""
    rest = [c for c in df.columns if c not in keys]
    packed = df.select(
        *keys, F.struct(*order).alias("__o"), F.struct(*[F.col(c) for c in rest]).alias("__r")
    )
    chosen = packed.groupBy(*keys).agg(F.max_by("__r", "__o").alias("__r"), F.min("__o").alias("__first"))
    return chosen.select(*keys, *[F.col(f"__first.{c}" if c in order else f"__r.{c}").alias(c) for c in rest])


def one_distinct(value: Column) -> Column:
    """The value when a group has exactly one distinct non-null value, else NULL."""
    return F.when(F.min(value) == F.max(value), F.min(value))
