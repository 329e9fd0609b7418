from pyspark.sql import functions as F

from noticemill.functions.deadlines import has_deadline_label, submission_deadline
from noticemill.operators import status as st
from noticemill.plans.tables import clock

from .helpers import notices, now

AMEND = ("title", "type", "published_date", "revised_closing_date", "url")


def amendment(**k):
    return tuple(k.get(f) for f in AMEND)


def resolved(spark, *rows, at="2026-09-30 12:00:00"):
    return [(r.status, r.effective_closing_date) for r in st.resolve_status(notices(spark, *rows), clock(at)).orderBy("ordinal").collect()]


CASES = [
    ({}, "ACTIVE_LIKELY", "2026-10-01"),
    ({"verification": "detail", "original_closing_date": "2026-10-01T15:00:00+05:30"}, "ACTIVE_VERIFIED", None),
    ({"verification": "detail", "original_closing_date": "2026-10-01T15:00:00+05:30", "fetched_at": "2026-09-20T00:00:00Z"}, "ACTIVE_LIKELY", None),
    ({"verification": "detail", "original_closing_date": "2026-10-01T15:00:00+05:30", "fetched_at": "2026-09-30T12:06:00Z"}, "ACTIVE_LIKELY", None),
    ({"verification": "detail"}, "ACTIVE_LIKELY", None),
    ({"verification": "detail", "original_closing_date": "2026-10-01T15:00:00+05:30", "date_precision": "day"}, "ACTIVE_LIKELY", None),
    ({"original_closing_date": None}, "DEADLINE_UNKNOWN", None),
    ({"original_closing_date": "garbage"}, "DEADLINE_UNKNOWN", None),
    ({"corrigenda": [amendment(published_date="2026-09-10", revised_closing_date="2026-10-20"),
                     amendment(published_date="2026-09-12", revised_closing_date="2026-10-05"),
                     amendment(published_date="2026-09-14", revised_closing_date="invalid")]}, "ACTIVE_LIKELY", "2026-10-05"),
    ({"corrigenda": [amendment(title="Cancellation of tender")]}, "CANCELLED", None),
    ({"corrigenda": [amendment(type="withdrawal")]}, "WITHDRAWN", None),
    ({"cancelled": True, "withdrawn": True}, "WITHDRAWN", None),
    ({"withdrawn": True, "corrigenda": [amendment(title="cancelled")]}, "CANCELLED", None),
    ({"original_closing_date": "2026-09-30T11:00:00Z"}, "EXPIRED", None),
    ({"original_closing_date": "2026-09-30"}, "ACTIVE_LIKELY", None),
]


def test_status_cases(spark):
    got = resolved(spark, *[c for c, _, _ in CASES])
    assert [s for s, _ in got] == [s for _, s, _ in CASES]
    for (_, effective), (_, _, wanted) in zip(got, CASES):
        assert wanted is None or effective == wanted
    assert resolved(spark, {"original_closing_date": "2026-09-30"}, at="2026-09-30 18:31:00")[0][0] == "EXPIRED"


def test_table_and_array_amendments_agree(spark):
    df = notices(spark, *[c for c, _, _ in CASES])
    long = df.select("notice_key", F.posexplode("corrigenda").alias("ordinal", "c")).select("notice_key", "ordinal", "c.*")
    a = st.resolve_status(df, now()).select("notice_key", "status", "effective_closing_date")
    b = st.resolve_status(df, now(), long).select("notice_key", "status", "effective_closing_date")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_current_candidates(spark):
    rows = [
        ({"original_closing_date": "2026-09-01", "corrigenda": [amendment(published_date="2026-09-05", revised_closing_date="2026-10-09")]}, True),
        ({"corrigenda": [amendment(title="Cancelled", revised_closing_date="2026-10-09")]}, False),
        ({"original_closing_date": None, "extended_closing_date": "bad"}, False),
        ({"original_closing_date": None}, True),
        ({"original_closing_date": None, "publish_date": "2030-01-01"}, False),
        ({"original_closing_date": None, "publish_date": "2026-01-01"}, False),
    ]
    df = st.resolve_status(notices(spark, *[r for r, _ in rows]), now())
    got = [r[0] for r in df.orderBy("ordinal").select(st.current_candidate(df, now())).collect()]
    assert got == [ok for _, ok in rows]


def test_refresh_at_read_time(spark):
    df = st.resolve_status(
        notices(spark, {"original_closing_date": "2026-09-30"},
                {"verification": "detail", "original_closing_date": "2026-10-05T15:00:00+05:30", "fetched_at": "2026-09-30T11:00:00Z"}), now())

    def at(text):
        return [r.status for r in st.refresh_elapsed(df, clock(text)).orderBy("ordinal").collect()]

    assert at("2026-09-30 18:29:59.999") == ["ACTIVE_LIKELY", "ACTIVE_VERIFIED"]
    assert at("2026-09-30 18:30:00") == ["EXPIRED", "ACTIVE_LIKELY"]


def _documents(spark, *rows):
    df = spark.createDataFrame(rows, "notice_key int, doc_type string, doc_status string, published_date string, text string")
    return df.withColumns({"has_label": has_deadline_label(F.col("text")), "deadline": submission_deadline(F.col("text"))})


def test_amendment_deadline_evidence(spark):
    docs = _documents(
        spark,
        (1, "corrigendum", "parsed", "2026-09-01", "Bid end date: 01-10-2026"),
        (1, "corrigendum", "parsed", "2026-09-05", "Bid end date: 09-10-2026"),
        (1, "corrigendum", "parsed", "2026-09-09", "No date field here"),
        (2, "corrigendum", "parsed", "2026-09-01", "Bid end date: 01-10-2026"),
        (2, "corrigendum", "parsed", None, "Bid end date: 05-10-2026"),
        (3, "corrigendum", "parsed", "2026-09-01", "Bid end date: unreadable"),
        (4, "tender-document", "parsed", None, "Bid end date: 07-10-2026"),
        (4, "tender-document", "parsed", None, "Closing date: 07-10-2026"),
        (5, "tender-document", "parsed", None, "Closing date: 07-10-2026"),
        (5, "tender-document", "parsed", None, "Closing date: 08-10-2026"),
    )
    assert {r.notice_key: r.date[:10] for r in st.latest_amendment_deadline(docs).collect()} == {1: "2026-10-09"}
    assert {r.notice_key: r.date[:10] for r in st.single_document_deadline(docs).collect()} == {4: "2026-10-07"}


def test_deadline_application(spark):
    df = notices(spark, {"original_closing_date": "2026-10-01"}, {"original_closing_date": "2026-10-02"}, {"original_closing_date": None},
                 {"original_closing_date": None, "notes": ["Deadline conflict: x"]})
    d = spark.createDataFrame([(i, "2026-10-01T15:00:00+05:30", "minute") for i in range(4)], "notice_key bigint, date string, date_precision string")
    r = {x.notice_key: x for x in st.reconcile_listing_deadline(df, d).collect()}
    assert r[0].original_closing_date == "2026-10-01T15:00:00+05:30" and r[0].date_precision == "minute"
    assert r[1].original_closing_date is None and "differ" in r[1].notes[0]
    f = {x.notice_key: x.original_closing_date for x in st.apply_document_deadline(df, d, F.lit(False)).collect()}
    assert f == {0: "2026-10-01", 1: "2026-10-02", 2: "2026-10-01T15:00:00+05:30", 3: None}
    a = {x.notice_key: x.extended_closing_date for x in st.apply_amendment_deadline(df, d, F.col("notice_key") == 1).collect()}
    assert a[0] == "2026-10-01T15:00:00+05:30" and a[1] is None
    late = d.withColumn("date", F.lit("2026-08-01T15:00:00+05:30"))
    assert {x.extended_closing_date for x in st.apply_amendment_deadline(df, late, F.lit(False)).collect()} == {None}
    days = df.withColumn("date_precision", F.lit("day"))
    u = {x.notice_key: x.original_closing_date for x in st.upgrade_reviewed_time(days, d).collect()}
    assert u == {0: "2026-10-01T15:00:00+05:30", 1: "2026-10-02", 2: None, 3: None}


def test_extensions_and_corrections(spark):
    am = spark.createDataFrame(
        [(1, 0, "2026-09-05", "2026-10-05"), (1, 1, "2026-09-01", "2026-10-09"), (1, 2, "2026-09-05", "2026-10-07"), (1, 3, None, "2026-12-01"),
         (2, 0, None, "2026-10-03")],
        "notice_key int, ordinal int, published_date string, revised_closing_date string")
    assert {r.notice_key: r.extended_closing_date for r in st.running_extension(am).collect()} == {1: "2026-10-07", 2: "2026-10-03"}
    assert {r.notice_key: r.ordinal for r in st.latest_amendment(am).collect()} == {1: 2, 2: 0}
    docs = spark.createDataFrame([("u", "h1"), ("u", "h2")], "url string, sha256 string")
    fix = spark.createDataFrame([("u", "h1", "2026-10-07T17:00:00+05:30")], "url string, sha256 string, date string")
    assert {r.sha256: r.reviewed_date for r in st.apply_corrections(docs, fix).collect()} == {"h1": "2026-10-07T17:00:00+05:30", "h2": None}
    df = notices(spark, {"publish_date": "2026-05-09", "original_closing_date": "2026-11-09",
                         "documents": [("d", "https://a.gov.in/sites/Spine%20System.pdf")]}, {"publish_date": "2026-05-09", "original_closing_date": "2026-11-09"})
    known = spark.createDataFrame([("Spine System.pdf", "2026-05-09", "2026-11-09", "B1")], "document_name string, published string, listed string, bid string")
    got = {r.notice_key: (r.original_closing_date, r.deadline_conflict) for r in st.guard_known_conflicts(df, known).collect()}
    assert got == {0: (None, True), 1: ("2026-11-09", False)}
