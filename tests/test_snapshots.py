from datetime import datetime, timedelta

from pyspark.sql import functions as F

from noticemill.operators import snapshots as sn
from noticemill.plans.record_queries import EVENT_INDEX, event_snapshots
from noticemill.plans.tables import clock
from noticemill.streaming.snapshots import SnapshotState, start_merge

T0 = datetime(2026, 9, 30, 0, 0)


def at(hours):
    return T0 + timedelta(hours=hours)


def history(spark, *snaps):
    """snaps: (source, hours, status, {identity: observed hours})"""
    control = [(s, at(h), st, at(h)) for s, h, st, _ in snaps]
    records = [(s, at(h), k, at(o)) for s, h, _, rows in snaps for k, o in rows.items()]
    c = spark.createDataFrame(control, "source_id string, attempted_at timestamp, status string, successful_at timestamp")
    r = spark.createDataFrame(records, "source_id string, attempted_at timestamp, identity string, observed_at timestamp")
    return c, r


def is_index():
    return F.startswith("source_id", F.lit("idx"))


SEQUENCES = [
    ("a", 0, "SUCCESS", {"A": 0}), ("a", 1, "SUCCESS", {}),
    ("b", 0, "SUCCESS", {"A": 0}), ("b", 1, "UNAVAILABLE", {}),
    ("idx-1", 0, "SUCCESS", {"A": 0}), ("idx-1", 1, "PARTIAL", {"B": 1}),
    ("idx-2", 0, "SUCCESS", {"A": 0}), ("idx-2", 1, "PARTIAL", {"A": 1}), ("idx-2", 2, "SUCCESS", {}),
    ("idx-3", 0, "SUCCESS", {"A": 0}), ("idx-3", 23, "PARTIAL", {}),
    ("idx-4", 0, "SUCCESS", {"A": 0}), ("idx-4", 23, "PARTIAL", {}), ("idx-4", 25, "PARTIAL", {}),
    ("idx-5", 0, "SUCCESS", {"A": 3}), ("idx-5", 1, "PARTIAL", {}),
    ("c", 0, "SUCCESS", {"A": 0}), ("c", 1, "PARTIAL", {}),
    ("idx-6", 0, "SUCCESS", {"A": 0}), ("idx-6", 1, "PARTIAL", {"B": 1}), ("idx-6", 2, "UNAVAILABLE", {}),
]
WANTED = {("b", "A", True), ("idx-1", "A", True), ("idx-1", "B", False), ("idx-3", "A", True), ("idx-6", "A", True), ("idx-6", "B", True)}


def test_history_rules(spark):
    c, r = history(spark, *SEQUENCES)
    got = {(x.source_id, x.identity, x.stale) for x in sn.latest_records(c, r, is_index()).collect()}
    assert got == WANTED
    last = {x.source_id: x for x in sn.latest_snapshots(c).collect()}
    assert last["b"].status == "UNAVAILABLE" and last["b"].stale and last["b"].successful_at == at(0)


def test_stepwise_merge_agrees_with_history(spark):
    state = None
    for hour in sorted({h for _, h, _, _ in SEQUENCES}):
        c, r = history(spark, *[s for s in SEQUENCES if s[1] == hour])
        if state is None:
            state = r.limit(0).withColumn("stale", F.lit(False))
        state = sn.merge_step(state, c, r, F.lit(at(hour)), is_index())
        rows = state.collect()
        state = spark.createDataFrame(rows, state.schema)
    assert {(x.source_id, x.identity, x.stale) for x in rows} == WANTED


def test_read_staleness(spark):
    rows = [("SUCCESS", "2026-09-30T11:50:00Z"), ("SUCCESS", "2026-09-30T11:40:00Z"), ("SUCCESS", "2026-09-30T12:10:00Z"), ("UNAVAILABLE", None), ("PARTIAL", "bad")]
    df = spark.createDataFrame([(i, s, t, "2026-09-30T11:59:00Z", False) for i, (s, t) in enumerate(rows)], "i int, status string, successful_at string, attempted_at string, stale boolean")
    got = [(r.status, r.stale) for r in sn.read_staleness(df, clock("2026-09-30 12:00:00")).orderBy("i").collect()]
    assert got == [("SUCCESS", False), ("PARTIAL", True), ("PARTIAL", True), ("UNAVAILABLE", False), ("PARTIAL", True)]


def test_snapshot_rows_and_tables(spark, tmp_path):
    recs = spark.createDataFrame([("s", at(0), "detail"), ("s", at(0), "listing")], "source_id string, attempted_at timestamp, verification string")
    b = spark.createDataFrame([("s", at(0), False, None), ("t", at(0), True, None), ("u", at(0), False, "timeout")], "source_id string, attempted_at timestamp, partial boolean, error string")
    rows = sn.snapshot_rows(recs, b)
    got = {r.source_id: (r.status, r.raw_records, r.detail_checks) for r in rows.collect()}
    assert got == {"s": ("SUCCESS", 2, 1), "t": ("PARTIAL", 0, 0), "u": ("UNAVAILABLE", 0, 0)}
    path = str(tmp_path / "snaps")
    sn.write_snapshots(rows, path)
    assert sn.read_snapshots(spark, path, clock("2026-10-06 00:00:00")).count() == 3
    assert sn.read_snapshots(spark, path, clock("2026-10-08 00:00:00")).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    control, records = event_snapshots(spark, "/root/testdata/sf0.001")
    c = control.select(F.lit("control").alias("kind"), "source_id", "attempted_at", "status", F.lit("").alias("identity"),
                       F.lit(None).cast("timestamp_ntz").alias("observed_at"), F.lit(None).cast("bigint").alias("event_id"))
    r = records.select(F.lit("record").alias("kind"), "source_id", "attempted_at", F.lit("").alias("status"), "identity", "observed_at", "event_id")
    rows = c.unionByName(r).cache()
    state = SnapshotState(spark, str(tmp_path / "state"), rows.schema, F.expr(EVENT_INDEX))
    inbox = str(tmp_path / "in")
    for lo, hi in ((1, 12), (12, 20), (20, 32)):
        rows.filter(F.dayofmonth("attempted_at").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(rows.schema).parquet(inbox)
        start_merge(stream, state, str(tmp_path / "cp")).awaitTermination()
    batch = {(x.source_id, x.identity, x.event_id, x.stale) for x in sn.latest_records(control, records, F.expr(EVENT_INDEX)).collect()}
    assert {(x.source_id, x.identity, x.event_id, x.stale) for x in state.current().collect()} == batch
    # Replaying a batch under its own id changes nothing.
    state.apply(rows.filter(F.dayofmonth("attempted_at") >= 20), 2)
    assert {(x.source_id, x.identity, x.event_id, x.stale) for x in state.current().collect()} == batch
