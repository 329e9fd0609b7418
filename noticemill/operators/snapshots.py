"""Latest state of each source from a history of snapshots, with bounded retention.

A snapshot is a control row (source_id, attempted_at, status, successful_at) plus
its records.  SUCCESS replaces everything.  PARTIAL replaces too, except for index
sources, where rows it did not see stay as stale while their own observation is at
most a day old.  UNAVAILABLE keeps the prior rows, stale, and does not advance the
success time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import instant
from ..functions.identifiers import present

# Retention and read limits in seconds, and the retention note.
KEEP_SECONDS, AHEAD_SECONDS, READ_SECONDS = 86_400, 300, 900
RETAINED_NOTE, FAILED_NOTE = "retained-from-earlier-fetch", "source-failed-earlier-records-kept"


def notice_identity(tender_id: Column, record_id: Column, url: Column) -> Column:
    return F.coalesce(F.upper(present(F.trim(tender_id))), present(record_id), present(url))


def _seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1_000_000


def source_control(snapshots: DataFrame, is_index: Column) -> DataFrame:
    """Per snapshot: whether it takes part in the current state, and the merge times after it.

    The control table has one row per source and attempt; records are never windowed.
    """
    w = Window.partitionBy("source_id").orderBy("attempted_at")
    usable = F.col("status") != "UNAVAILABLE"
    full = usable & ~((F.col("status") == "PARTIAL") & is_index)
    later = w.rowsBetween(1, Window.unboundedFollowing)
    every = Window.partitionBy("source_id")
    return (
        snapshots.withColumns({"__usable": usable, "__full": full})
        .withColumns(
            {
                "last_full_at": F.max(F.when(F.col("__full"), F.col("attempted_at"))).over(every),
                "last_usable_at": F.max(F.when(F.col("__usable"), F.col("attempted_at"))).over(every),
                "last_attempt_at": F.max("attempted_at").over(every),
                "next_merge_at": F.min(F.when(F.col("__usable"), F.col("attempted_at"))).over(later),
            }
        )
        .filter(F.col("__usable") & (F.col("last_full_at").isNull() | (F.col("attempted_at") >= F.col("last_full_at"))))
        .select("source_id", "attempted_at", "last_full_at", "last_usable_at", "last_attempt_at", "next_merge_at")
    )


def latest_records(
    snapshots: DataFrame, records: DataFrame, is_index: Column, identity: str = "identity", observed: str = "observed_at"
) -> DataFrame:
    """Current records per (source_id, identity) with ``stale`` and ``retained_note``.

    ``records`` has source_id, attempted_at, identity and observed_at.  The newest
    sighting of an identity is an ordered aggregate, so a source with a third of all
    rows is combined map-side instead of being sorted in one task.
    """
    control = source_control(snapshots, is_index)
    live = records.join(control, ["source_id", "attempted_at"])
    rest = [c for c in records.columns if c not in ("source_id", identity)]
    newest = (
        live.filter(F.col(identity).isNotNull())
        .groupBy("source_id", identity)
        .agg(
            F.max_by(
                F.struct(*rest, "last_usable_at", "last_attempt_at", "next_merge_at"), F.col("attempted_at")
            ).alias("r")
        )
        .select("source_id", identity, "r.*")
    )
    seen_now = F.col("attempted_at") == F.col("last_usable_at")
    kept = (
        (_seconds(F.col("last_usable_at"), F.col(observed)) <= KEEP_SECONDS)
        & (_seconds(F.col(observed), F.col("next_merge_at")) <= AHEAD_SECONDS)
    )
    return (
        newest.filter(seen_now | F.coalesce(kept, F.lit(False)))
        .withColumn("stale", ~seen_now | (F.col("last_attempt_at") > F.col("last_usable_at")))
        .withColumn("retained_note", F.when(~seen_now, RETAINED_NOTE))
        .drop("last_usable_at", "last_attempt_at", "next_merge_at")
    )


def record_counts(latest: DataFrame) -> DataFrame:
    """(source_id, raw_records, retained_records): what each source shows now, retained rows included."""
    return latest.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("raw_records"), F.count("retained_note").alias("retained_records")
    )


def latest_snapshots(snapshots: DataFrame, metrics: tuple[str, ...] = ("raw_records", "detail_checks")) -> DataFrame:
    """Newest control row per source.

    After a failure the success time and the metrics of the last usable snapshot stay, the row is stale and says so.
    """
    usable = F.when(F.col("status") != "UNAVAILABLE", F.col("attempted_at"))
    kept = [F.coalesce(F.max_by(c, usable), F.max_by(c, "attempted_at")).alias(c) for c in metrics if c in snapshots.columns]
    last = snapshots.groupBy("source_id").agg(
        F.max_by("status", "attempted_at").alias("status"),
        F.max("attempted_at").alias("attempted_at"),
        F.max_by("successful_at", usable).alias("successful_at"),
        *kept,
    )
    stale = (F.col("status") == "UNAVAILABLE") & F.col("successful_at").isNotNull()
    return last.withColumns({"stale": stale, "retained_note": F.when(stale, FAILED_NOTE)})


def merge_step(
    state: DataFrame, batch_control: DataFrame, batch_records: DataFrame, now: Column, is_index: Column,
    identity: str = "identity", observed: str = "observed_at",
) -> DataFrame:
    """One merge: state rows and one new snapshot per source give the next state rows.

    Sources without a control row in the batch are unchanged.
    """
    control = batch_control.select(
        "source_id",
        F.col("status").alias("__status"),
        ((F.col("status") == "PARTIAL") & is_index).alias("__retain"),
    )
    incoming = batch_records.join(
        control.filter("__status <> 'UNAVAILABLE'").select("source_id"), "source_id", "left_semi"
    ).withColumn("stale", F.lit(False))
    prior = state.join(control, "source_id", "left")
    untouched = prior.filter(F.col("__status").isNull())
    failed = prior.filter(F.col("__status") == "UNAVAILABLE").withColumn("stale", F.lit(True))
    age = _seconds(now, F.col(observed))
    unseen = (
        prior.filter(F.col("__retain") & F.col(identity).isNotNull() & age.between(-AHEAD_SECONDS, KEEP_SECONDS))
        .join(incoming.select("source_id", identity).distinct(), ["source_id", identity], "left_anti")
        .withColumn("stale", F.lit(True))
    )
    drop = ("__status", "__retain")
    return (
        incoming.unionByName(untouched.drop(*drop), allowMissingColumns=True)
        .unionByName(failed.drop(*drop), allowMissingColumns=True)
        .unionByName(unseen.select(*[c for c in prior.columns if c not in drop]), allowMissingColumns=True)
    )


def read_staleness(snapshots: DataFrame, now: Column) -> DataFrame:
    """Read-time view: an old or future observation is stale, and stale SUCCESS reads as PARTIAL."""
    observed = instant(F.coalesce(present(F.col("successful_at")), F.col("attempted_at")))
    age = _seconds(now, observed)
    stale = (
        F.coalesce(F.col("stale"), F.lit(False))
        | observed.isNull()
        | ~F.coalesce(age.between(-AHEAD_SECONDS, READ_SECONDS), F.lit(False))
    )
    return snapshots.withColumn("stale", stale).withColumn(
        "status", F.when(F.col("stale") & (F.col("status") == "SUCCESS"), "PARTIAL").otherwise(F.col("status"))
    )


def snapshot_rows(records: DataFrame, batches: DataFrame) -> DataFrame:
    """Snapshot row per batch: status, record count and detail checks.

    ``batches`` has source_id, attempted_at, partial and error; a batch with an error is UNAVAILABLE.
    """
    counts = records.groupBy("source_id", "attempted_at").agg(
        F.count(F.lit(1)).alias("raw_records"),
        F.count_if(F.col("verification") == "detail").alias("detail_checks"),
    )
    status = (
        F.when(F.col("error").isNotNull(), "UNAVAILABLE")
        .when(F.coalesce(F.col("partial"), F.lit(False)), "PARTIAL")
        .otherwise("SUCCESS")
    )
    return (
        batches.join(counts, ["source_id", "attempted_at"], "left")
        .withColumns(
            {
                "status": status,
                "successful_at": F.when(F.col("error").isNull(), F.col("attempted_at")),
                "raw_records": F.coalesce("raw_records", F.lit(0)),
                "detail_checks": F.coalesce("detail_checks", F.lit(0)),
            }
        )
        .drop("partial")
    )


def write_snapshots(df: DataFrame, path: str) -> None:
    """Durable snapshots, partitioned by source."""
    df.write.mode("append").partitionBy("source_id").parquet(path)


def read_snapshots(spark, path: str, now: Column, keep_days: int = 7, sources: list[str] | None = None) -> DataFrame:
    """Snapshots still inside their lifetime, of the named sources if any are named; a row without a source is refused."""
    df = spark.read.parquet(path).filter(F.col("source_id").isNotNull())
    if sources is not None:
        df = df.filter(F.col("source_id").isin(sources))
    return df.filter(_seconds(now, F.col("attempted_at")) <= keep_days * 86_400)
