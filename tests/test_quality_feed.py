import json

from pyspark.sql import functions as F

from noticemill.operators import feed, quality
from noticemill.sources import medical_rules as rules

from .helpers import notices
from .test_search import gold

ORIGIN = "https://feed.gov.in"
Q = "notice_key bigint, ordinal bigint, requirement string, quantity string, doc_url string, doc_type string, label string, page int, sheet string, row int"


def feed_rows(spark, rows, quantities):
    n = gold(spark, *rows).withColumn("equipment_types", F.when(F.col("notice_key") == 4, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("A"))))
    q = spark.createDataFrame(quantities, Q)
    return n, feed.feed_items(n, q, ORIGIN)


def test_item_ladder(spark):
    item = ("i1", "Bed <b>x</b>", "5", None, "https://a.gov.in/b", "BOQ", 2, None, None)
    blank = (None, "", "5", None, None, None, None, None, None)
    rows = [{"equipment_items": [item, (None, "Pump", "2 sets", None, None, None, None, None, None)]}, {"equipment_items": [blank]}, {}, {}, {}, {}]
    quantities = [
        (1, 7, "Bed | Qty: 4", "4", "https://a.gov.in/q.xlsx", "boq", "BOQ", None, "S1", 3),
        (0, 1, "Bed | Qty: 4", "4", "https://a.gov.in/q.xlsx", "boq", "BOQ", None, "S1", 3),
        (2, 1, "Total quantity: 12 nos", "12", "https://a.gov.in/t.pdf", "tender-document", "T", 4, None, None),
        (2, 2, "Accessories quantity per bed 3", "3", "https://a.gov.in/t.pdf", "tender-document", "T", 4, None, None),
        (3, 1, "Quantity: 12", "12", "https://a.gov.in/t.pdf", "tender-document", "T", 4, None, None),
        (3, 2, "Quantity: 13", "13", "https://a.gov.in/t.pdf", "tender-document", "T", 4, None, None),
        (4, 1, "Quantity: 12", "12", "https://a.gov.in/t.pdf", "tender-document", "T", 4, None, None),
    ]
    _, items = feed_rows(spark, rows, quantities)
    got = {}
    for r in items.orderBy("notice_key", "item_ordinal").collect():
        got.setdefault(r.notice_key, []).append(r)
    assert [(r.item_id, r.equipment, r.quantity, r.quantity_text) for r in got[0]] == [("i1", "Bed x", 5, "5"), ("item-2", "Pump", None, "2 sets")]
    assert [(r.item_id, r.quantity, r.source_row) for r in got[1]] == [("boq-S1-3-0", 4, 3)]
    assert [(r.item_id, r.quantity, r.source_label) for r in got[2]] == [("unstructured-title", 12, "T")]
    assert got[3][0].quantity is None and got[4][0].quantity is None and got[5][0].source_label == feed.TITLE_LABEL


def test_fingerprint_changes_and_guard(spark):
    rows = [{"id": "a"}, {"id": "b"}, {"id": "c", "corrigenda": [("Ext", None, "2026-09-02", "2026-10-09", "/c.pdf")]}]
    n, _ = feed_rows(spark, rows, [])
    none = spark.createDataFrame([], Q)
    first, rejected = feed.feed_notices(n, none, ORIGIN)
    assert rejected.isEmpty()
    row = {r.external_id: r for r in first.collect()}
    assert row["c"].deadline == "2026-10-05T18:29:59.999Z" and row["c"].source_updated_at == "2026-09-02T00:00:00.000Z"
    assert row["c"].revisions[0].url == "https://feed.gov.in/c.pdf" and row["a"].publication_date == "2026-09-01T00:00:00.000Z"
    later = n.withColumn("fetched_at", F.lit("2026-10-01T00:00:00Z")).filter("id <> 'a'").withColumn("title", F.when(F.col("id") == "b", "New").otherwise(F.col("title")))
    changed = feed.detect_changes(feed.feed_notices(later, none, ORIGIN)[0], first)
    assert {r.external_id: r.change for r in changed.collect()} == {"a": "removed", "b": "changed", "c": "same"}
    schedule = spark.createDataFrame([(k, i, f"Bed {i}", "1", "/q.xlsx", "boq", "BOQ", None, "S", 1) for k, m in ((0, 101), (1, 100)) for i in range(m)], Q)
    ok, rejected = feed.feed_notices(n, schedule, ORIGIN)
    assert {r.notice_key: len(r["items"]) for r in ok.collect()} == {1: 100, 2: 1} and [r.notice_key for r in rejected.collect()] == [0]


def test_long_schedules_keep_all_items(spark):
    n, _ = feed_rows(spark, [{"id": "a"}, {"id": "b"}], [])
    schedule = spark.createDataFrame([(0, i, f"Bed {i}", "1", "/q.xlsx", "boq", "BOQ", None, "S", 1) for i in reversed(range(150))], Q)
    wanted = [f"boq-S-1-{i}" for i in range(150)]
    rows = feed.feed_items(n, schedule, ORIGIN).filter("notice_key = 0").orderBy("item_ordinal").collect()
    assert [r.item_id for r in rows] == wanted and [r.equipment for r in rows] == [f"Bed {i}" for i in range(150)]
    _, rejected = feed.feed_notices(n, schedule, ORIGIN)
    assert [(r.notice_key, r.item_count) for r in rejected.collect()] == [(0, 150)]
    assert feed.feed_items(rejected, schedule, ORIGIN).count() == 150
    assert [r.notice_key for r in feed.feed_notices(n, schedule, ORIGIN, item_limit=149)[1].collect()] == [0]
    ok, rejected = feed.feed_notices(n, schedule, ORIGIN, item_limit=150)
    assert [i.item_id for i in ok.filter("notice_key = 0").collect()[0]["items"]] == wanted and rejected.isEmpty()


def test_documents_by_address_and_dates(spark):
    rows = [{"id": "a", "documents": [("one", "/a.pdf"), ("two", "/b.pdf"), ("three", "/a.pdf")], "fetched_at": "later"}]
    n, _ = feed_rows(spark, rows, [])
    n = n.withColumn("specification_documents", F.expr("array(named_struct('label', 'four', 'url', '/b.pdf', 'published_date', '2026-09-09'))"))
    n = n.withColumn("checked_at", F.lit("2026-09-30T10:00:00Z"))
    row = feed.feed_notices(n, spark.createDataFrame([], Q), ORIGIN, list_limit=1)[0].collect()[0]
    assert [(d.label, d.url) for d in row.documents] == [("three", ORIGIN + "/a.pdf")] and row.truncated
    assert row.source_updated_at == "2026-09-09T00:00:00.000Z" and row.discovered_at == "2026-09-30T10:00:00.000Z"


def test_funnel_and_summary(spark):
    raw = spark.createDataFrame([("s", 1, False, True), ("s", 0, True, True), ("s", 0, False, True), ("s", 2, False, False), ("t", 0, True, False)],
                                "source_id string, entity_count int, is_statewide boolean, is_relevant boolean")
    funnel = quality.source_funnel(raw)
    s = {r.source_id: r for r in funnel.collect()}["s"]
    assert (s.raw_records, s.institution_matches, s.medical_matches, s.false_positives_rejected, s.unassigned_rejected) == (4, 2, 2, 1, 1)
    total = quality.summary(funnel, gold(spark, {"status": "WITHDRAWN"})).collect()[0]
    assert total.medical_relevant == 2 and total.cancelled == 1 and total.duplicates_removed == 1


def test_category_audit(spark):
    t = gold(spark, {"priority_categories": ["VENTILATORS", "ULTRASOUND"], "extraction_status": "complete"},
             {"priority_categories": ["VENTILATORS"], "status": "DEADLINE_UNKNOWN"}, {"priority_categories": ["VENTILATORS"], "status": "DEADLINE_UNKNOWN"},
             {"priority_categories": ["VENTILATORS"], "status": "EXPIRED"}).withColumn("is_current", F.col("notice_key") != 2)
    docs = spark.createDataFrame(
        [(0, 0, "https://a/x.pdf", "T", "tender-document", "deferred", None), (0, 1, "https://a/x.pdf", "T", "technical-specification", "parsed", "pdf-text"),
         (0, 2, "https://a/app?page=FrontEndViewTender", "a.pdf", "tender-document", "unavailable", None), (0, 3, "https://a/page", "plain", "tender-document", "deferred", None),
         (1, 0, "https://a/showbidDocument/1", "b", "boq", "parsed", "pdf-text"), (1, 1, "https://a/scan", "s", "tender-document", "scanned", "reviewed-scan"),
         (2, 0, "https://a/z.pdf", "z", "boq", "parsed", None), (3, 0, "https://a/w.pdf", "w", "boq", "parsed", None)],
        "notice_key bigint, ordinal int, url string, label string, doc_type string, doc_status string, text_method string")
    cand = spark.createDataFrame([("VENTILATORS", "s", True, True), ("VENTILATORS", "t", True, False), ("VENTILATORS", "t", False, False)],
                                 "grp string, source_id string, is_relevant boolean, is_confirmed boolean")
    out = {r.grp: r for r in quality.category_audit(cand, t, docs, quality.group_table(spark)).collect()}
    v = out["VENTILATORS"]
    assert len(out) == len(rules.PRIORITY_GROUPS) and out["C_ARM"].raw_candidates == 0
    assert (v.raw_candidates, v.false_positives_rejected, v.unconfirmed_category_candidates, v.candidate_sources) == (3, 1, 1, 2)
    assert (v.active_likely, v.deadline_unknown, v.potentially_current_deadline_unknown, v.complete, v.not_processed) == (1, 2, 1, 1, 1)
    assert (v.documents_found, v.technical_documents_found, v.technical_documents_parsed, v.reviewed_scans, v.boqs_parsed) == (3, 2, 1, 1, 1)


def test_metrics_inventory_and_totals(spark, tmp_path):
    rows = spark.createDataFrame([("s", ["A", "B"], True, True, True, False), ("s", ["A"], False, False, False, True), ("t", [], False, False, False, True)],
                                 "source_id string, discovery_groups array<string>, is_generic boolean, is_title_relevant boolean, is_selected boolean, is_deferred boolean")
    m = {r.source_id: r for r in quality.discovery_metrics(rows).collect()}
    assert m["s"].raw_candidates == {"A": 2, "B": 1} and m["s"].rejected_candidates == 1 and m["t"].raw_candidates is None
    t = gold(spark, {"documents": [("a", "u")], "procurement_scope": "statewide"}, {"effective_closing_date": "bad", "status": "DEADLINE_UNKNOWN", "institution_id": "i"})
    inv = quality.source_inventory(t, t).collect()[0]
    assert (inv.dates_available, inv.documents_linked, inv.deadline_unknown_relevant) == (1, 1, 1)
    snaps = spark.createDataFrame([("s", "SUCCESS", "2026-09-30"), ("t", "PARTIAL", "2026-10-01"), ("u", "UNAVAILABLE", None)], "source_id string, status string, successful_at string")
    totals = quality.run_totals(snaps, t).collect()[0]
    assert (totals.sources_attempted, totals.sources_partial, totals.active_entities, totals.active_statewide) == (3, 1, 0, 1)
    assert quality.last_refreshed(snaps).collect()[0][0] == "2026-10-01"
    located = notices(spark, {}, {}).withColumn("resolved_region", F.when(F.col("notice_key") == 0, "Punjab"))
    assert quality.omitted_without_region(located).collect()[0].omitted == 1
    quality.write_audit({"totals": quality.run_totals(snaps, t)}, str(tmp_path))
    assert json.loads(spark.read.text(str(tmp_path / "totals")).collect()[0].value)["sources_attempted"] == 3


def test_the_address_of_a_notice_is_worked_out_once(spark):
    n, _ = feed_rows(spark, [{"id": "a"}], [])
    n = n.withColumn("tender_url", F.concat(F.lit("https://once.gov.in/"), F.col("notice_key").cast("string")))
    plan = feed._ladder(n, spark.createDataFrame([], Q), ORIGIN)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("https://once.gov.in/") == 1
