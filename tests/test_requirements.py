from pyspark.sql import functions as F

from noticemill.operators.requirements import (
    apply_document_text, document_description, extract_requirements, guard_identity, promote_document_scope, spreadsheet_rows,
)
from noticemill.operators.search import section_view

from .helpers import notices, values

RUN, RUN2 = "Battery runtime shall be 30 minutes", "Battery runtime amended: read as 60 minutes"
CHARGE = "Battery charge time shall be 2 hours"


def extract(spark, cases):
    """cases: {key: [(doc_type, published, text, extra)]}"""
    docs, pages = [], []
    for key, documents in cases.items():
        for i, (kind, published, text, *rest) in enumerate(documents):
            extra = rest[0] if rest else {}
            docs.append((key, i, f"u{i}", "label", kind, extra.get("status", "parsed"), published, extra.get("method", "pdf-text")))
            for p, page in enumerate(text if isinstance(text, list) else [text]):
                pages.append((key, i, p, p + 1, extra.get("sheet"), extra.get("row"), page))
    d = spark.createDataFrame(docs, "notice_key string, doc_ordinal int, doc_url string, label string, doc_type string, doc_status string, published_date string, text_method string").coalesce(1)
    p = spark.createDataFrame(pages, "notice_key string, doc_ordinal int, page_ordinal int, page int, sheet string, row int, text string").coalesce(1)
    d = d.withColumn("groups", F.array(F.lit("VENTILATORS")))
    r = extract_requirements(p, d, groups="groups")
    clauses, old = {}, {}
    for c in r.clauses.collect():
        clauses.setdefault(c.notice_key, []).append(c)
    for c in r.superseded.collect():
        old.setdefault(c.notice_key, []).append(c)
    return clauses, old, {s.notice_key: s for s in r.status.collect()}, r


SPEC, COR = "technical-specification", "corrigendum"


def test_supersession_and_safety(spark):
    cases = {
        "replace": [(SPEC, None, RUN), (COR, "2026-09-05", RUN2)],
        "unrelated": [(SPEC, None, RUN), (COR, "2026-09-05", "Battery recharge cycle amended: read as 500")],
        "keep-rest": [(SPEC, None, f"{RUN}\n{CHARGE}"), (COR, "2026-09-05", RUN2)],
        "undated-peer": [(SPEC, None, RUN), (COR, "2026-09-05", RUN2), (COR, None, "Battery runtime amended: read as 90 minutes")],
        "same-day": [(SPEC, None, RUN), (COR, "2026-09-05", RUN2), (COR, "2026-09-05", "Battery runtime amended: read as 90 minutes")],
        "same-day-swapped": [(COR, "2026-09-05", RUN2), (COR, "2026-09-05", "Battery runtime amended: read as 90 minutes"), (SPEC, None, RUN)],
        "contradiction": [(SPEC, None, RUN), (COR, "2026-09-05", f"{RUN2}\nBattery runtime amended: read as 90 minutes")],
        "chain": [(SPEC, None, RUN), (COR, "2026-09-07", "Battery runtime amended: read as 90 minutes"), (COR, "2026-09-05", RUN2)],
        "only-undated": [(SPEC, None, RUN), (COR, None, RUN2)],
        "two-targets": [(SPEC, None, f"{RUN}\nBattery runtime shall be 45 minutes"), (COR, "2026-09-05", RUN2)],
        "wrapped": [(SPEC, None, RUN), (COR, "2026-09-05", "Battery runtime amended to read as:\n60 minutes"), (COR, "2026-09-05", "Battery runtime amended to read as:\n90 minutes")],
        "new-clause": [(SPEC, None, "Turbine driven"), (COR, "2026-09-05", RUN2)],
    }
    clauses, old, status, _ = extract(spark, cases)
    battery = {k: len([c for c in v if c.field == "Battery"]) for k, v in clauses.items()}
    replaced = {k: len(old.get(k, [])) for k in cases}
    assert battery == {"replace": 1, "unrelated": 2, "keep-rest": 2, "undated-peer": 3, "same-day": 3, "same-day-swapped": 3,
                       "contradiction": 3, "chain": 1, "only-undated": 1, "two-targets": 3, "wrapped": 3, "new-clause": 1}
    assert replaced == {"replace": 1, "unrelated": 0, "keep-rest": 1, "undated-peer": 0, "same-day": 0, "same-day-swapped": 0,
                        "contradiction": 0, "chain": 2, "only-undated": 1, "two-targets": 0, "wrapped": 0, "new-clause": 0}
    complete = {k for k, s in status.items() if s.extraction_status == "complete"}
    assert complete == {"replace", "keep-rest", "chain", "only-undated", "new-clause"}
    assert clauses["chain"][0].requirement.endswith("90 minutes") and clauses["replace"][0].value == "60 minutes"
    assert {o.superseded_by for o in old["chain"]} == {"u1", "u2"}


def test_clause_fields(spark):
    text = "\n".join(
        [
            "Page 1", "searched strings", "infusion pump", "technical specification", "Inspiratory flow rate 60 lpm", "Flow rate 5",
            "Syringe flow rate 5", "Humidifier, qty: 2", "Sensor trolley pack of 4", "Warranty 5 years", "CMC after warranty 5 years",
            "Optional oxygen hose", "ISO 13485 required", "Total quantity: 12", "Turbine:", "built in", "Warranty 5 years",
        ]
    )
    clauses, _, status, r = extract(spark, {"n": [("tender-document", None, text)]})
    got = {(c.section, c.field): c for c in clauses["n"]}
    assert ("technicalRequirements", "Ventilation parameters") in got and ("technicalRequirements", "Flow and pressure") in got
    assert got[("technicalRequirements", "Infusion and syringe delivery")].requirement == "Syringe flow rate 5"
    assert got[("accessories", "Humidifier")].quantity == "2" and got[("accessories", "trolley")].quantity == "4"
    assert got[("warranty", "Warranty")].requirement == "Warranty 5 years"
    assert len([c for c in clauses["n"] if c.section == "warranty"]) == 1
    gas = [c for c in clauses["n"] if c.field == "Gas supply"]
    assert {c.requirement: c.mandatory for c in gas} == {"Optional oxygen hose": "false", "Turbine: built in": "unknown"}
    assert got[("regulatoryRequirements", "Regulatory requirements")].mandatory == "true"
    assert got[("quantity", "Quantity / line items")].requirement in ("Humidifier, qty: 2", "Total quantity: 12")
    assert "infusion pump" not in {c.requirement for c in clauses["n"]}
    assert status["n"].extraction_status == "complete"
    view = section_view(r.clauses).collect()
    assert [v.position for v in view] == sorted(v.position for v in view) and view[0].section == "quantity"


def test_sections_carry_over_pages_and_completeness(spark):
    cases = {
        "carry": [("tender-document", None, ["categories selected for notification", "Turbine hidden", "Buyer added\nTurbine shown"])],
        "scan": [(SPEC, None, "Turbine", {"method": "reviewed-scan"})],
        "gone": [(SPEC, None, "Turbine", {"status": "unavailable"})],
        "header": [("boq", None, "Quantity | Unit", {"sheet": "S1", "row": 1})],
    }
    clauses, _, status, _ = extract(spark, cases)
    assert [c.requirement for c in clauses["carry"]] == ["Turbine shown"]
    assert "header" not in clauses and "gone" not in clauses
    assert {k: s.extraction_status for k, s in status.items()} == {
        "carry": "partial", "scan": "partial", "gone": "document-unavailable", "header": "partial",
    }


def test_spreadsheet_rows(spark):
    cells = [("u", "S", 1, 1, "Item Description"), ("u", "S", 1, 2, "Qty"), ("u", "S", 2, 1, "Bed"), ("u", "S", 2, 2, "5"), ("u", "S", 2, 3, "x"), ("u", "T", 1, 1, "alone")]
    df = spark.createDataFrame(cells, "doc_url string, sheet string, row int, column int, text string")
    got = {(r.sheet, r.row): r.text for r in spreadsheet_rows(df).collect()}
    assert got == {("S", 1): "Item Description | Qty", ("S", 2): "Item Description: Bed | Qty: 5 | x", ("T", 1): "alone"}


def test_promotion_and_guard(spark):
    df = notices(spark, {"title": "ICU equipment"}, {"title": "ICU equipment"}, {"title": "Bed"}).withColumn("is_generic", F.col("notice_key") < 2)
    docs = spark.createDataFrame([(0, 0, "tender-document", "parsed"), (1, 0, "corrigendum", "parsed"), (2, 0, "tender-document", "parsed")],
                                 "notice_key bigint, doc_ordinal int, doc_type string, doc_status string")
    page = "Technical Specifications\nICU ventilator with turbine"
    pages = spark.createDataFrame([(i, 0, 0, page) for i in range(3)], "notice_key bigint, doc_ordinal int, page_ordinal int, text string")
    got = {r.notice_key: r for r in promote_document_scope(df, pages, docs).collect()}
    assert got[0].is_promoted and "ICU ventilator" in got[0].document_product_scope and "ICU ventilator" in got[0].description
    assert not got[1].is_promoted and not got[2].is_promoted
    d = spark.createDataFrame([("parsed", "GEM/2026/B/2"), ("parsed", "GEM/2026/B/1")], "doc_status string, text string").coalesce(1)
    assert [(r.doc_status, r.text) for r in guard_identity(d, F.lit("GEM/2026/B/1")).collect()] == [("unavailable", ""), ("parsed", "GEM/2026/B/1")]
    assert values(spark, ["Page 1 of 3\nBed\n-- 2 of 3 --\nUnit"], document_description) == ["Bed\nUnit"]


def test_document_text_replaces_the_description(spark):
    df = notices(spark, {"tender_id": "GEM/2026/B/1"}, {"tender_id": "GEM/2026/B/2", "description": "kept"}, {"description": "kept"})
    docs = spark.createDataFrame([(0, "u", "Page 1\nGEM/2026/B/1 beds"), (1, "u", "GEM/2026/B/9")], "notice_key bigint, url string, text string")
    got = {r.notice_key: r for r in apply_document_text(df, docs).collect()}
    assert got[0].description == "GEM/2026/B/1 beds" and [x.url for x in got[0].source_references] == ["https://a.gov.in/list", "u"]
    assert got[1].description == "kept" and got[2].description == "kept" and got[1].source_references is None
