from pyspark.sql import functions as F

from noticemill.operators import search as se
from noticemill.operators.search import Filters

from .helpers import notices, now

GOLD = {"institution_name": "string", "effective_closing_date": "string", "status": "string", "categories": "array<string>",
        "brand_matches": "array<struct<brand:string,match_type:string,terms:array<string>>>", "matched_keywords": "array<string>",
        "priority_categories": "array<string>", "confidence": "double", "checked_at": "string", "extraction_status": "string"}


def gold(spark, *rows):
    base = {"status": "ACTIVE_LIKELY", "effective_closing_date": "2026-10-05", "categories": ["VENTILATION"], "brand_matches": [],
            "matched_keywords": [], "priority_categories": [], "confidence": 0.76}
    return notices(spark, *[{**base, **r} for r in rows], **GOLD)


def keys(df):
    return [r.notice_key for r in df.collect()]


def test_facets_are_conjunctive(spark):
    df = gold(
        spark,
        {"title": "ICU Ventilator", "region": "Punjab", "consignees": [("gmc", "GMC Patiala")], "procurement_scope": "institution",
         "priority_categories": ["VENTILATORS"], "source_references": [("s9", "S9", "u")],
         "brand_matches": [("LINET", "portfolio", ["bed"]), ("KARL STORZ", "explicit-brand", ["storz"])]},
        {"title": "ICU Ventilator", "region": "Haryana", "status": "DEADLINE_UNKNOWN", "effective_closing_date": None},
        {"title": "Bed", "region": "Punjab", "effective_closing_date": "2026-12-05", "brand_matches": [("LINET", "explicit-model", ["Sprint"])]},
    )
    cases = {
        Filters(query=" ventilator  PATIALA"): [0],
        Filters(query="storz"): [0],
        Filters(status="all"): [0, 1, 2],
        Filters(region="Punjab", institution="gmc", scope="institution", category="VENTILATION", priority_equipment="VENTILATORS"): [0],
        Filters(region="Haryana", institution="gmc"): [],
        Filters(brand="LINET"): [0, 2],
        Filters(brand="LINET", explicit=True): [2],
        Filters(explicit=True): [0, 2],
        Filters(source="s9"): [0],
        Filters(source="s1"): [0, 2],
        Filters(source="s3"): [],
        Filters(closing=7): [0],
        Filters(status="DEADLINE_UNKNOWN"): [1],
    }
    for f, want in cases.items():
        assert sorted(keys(se.filter_tenders(df, f, now()))) == want, f
    # Every filter reaches the plan as one conjunction; unset facets add nothing.
    assert se.filter_tenders(df, Filters(status="all"), now()) is df


def test_sort_orders(spark):
    brand = [("LINET", "portfolio", ["bed"])]
    rows = [
        {"effective_closing_date": "2026-10-09"},
        {"effective_closing_date": "2026-10-05", "brand_matches": brand},
        {"effective_closing_date": "2026-10-05", "status": "ACTIVE_VERIFIED", "fetched_at": "2026-09-30T11:00:00Z"},
        {"effective_closing_date": None, "publish_date": None, "brand_matches": brand, "confidence": 0.9},
        {"effective_closing_date": "2026-10-01", "publish_date": "2026-09-20"},
    ]
    plain, listed = gold(spark, *rows), gold(spark, *rows[:-1], {**rows[-1], "priority_categories": ["X"]})
    assert keys(se.filter_and_sort(plain, Filters(status="all"), now())) == [1, 3, 4, 2, 0]
    assert keys(se.filter_and_sort(plain, Filters(status="all", prioritize=False), now())) == [4, 1, 2, 0, 3]
    # With priority data, urgency comes before the portfolio preference.
    assert keys(se.filter_and_sort(listed, Filters(status="all"), now())) == [4, 1, 2, 0, 3]
    assert keys(se.filter_and_sort(plain, Filters(status="all", sort="newest", prioritize=False), now())) == [4, 0, 1, 2, 3]
    assert keys(se.filter_and_sort(plain, Filters(status="all", sort="relevance", prioritize=False), now())) == [3, 0, 1, 2, 4]


def test_views_links_and_statewide(spark):
    manual = "https://etenders.gov.in/eprocure/app?page=FrontEndViewTender&x=1"
    df = gold(
        spark,
        {"tender_id": "GEM/2026/B/12", "source_references": [("s", "S", "https://bidplus.gem.gov.in/showbidDocument/9")], "procurement_scope": "statewide"},
        {"tender_url": manual, "documents": [("Doc", manual), ("Spec", "https://a.gov.in/s.pdf"), ("Old", "http://a.gov.in/x.pdf")],
         "corrigenda": [("Extension", None, None, None, "https://a.gov.in/c.pdf")], "institution_id": "i", "procurement_scope": "statewide"},
    )
    assert keys(se.filter_tenders(df, Filters(view="gem"), now())) == [0]
    assert keys(se.filter_tenders(df, Filters(view="manual"), now())) == [1]
    assert keys(se.statewide(df)) == [0]
    known = spark.createDataFrame([("GEM/2026/B/12", "https://bidplus.gem.gov.in/showbidDocument/1")], "bid string, url string")
    links = {r.notice_key: [(x.label, x.url) for x in r.links] for r in se.document_inventory(df, known).collect()}
    assert [label for label, _ in links[0]] == ["Open GeM bid", "Official GeM link", "Official notice"]
    assert links[1] == [("Open official tender & documents", manual), ("Spec", "https://a.gov.in/s.pdf"), ("Extension", "https://a.gov.in/c.pdf")]


def test_facet_counts_and_json(spark, tmp_path):
    df = gold(spark, {"categories": ["A", "B"]}, {"categories": ["A"], "status": "DEADLINE_UNKNOWN"})
    got = {(r.facet, r.value): (r.active, r.unknown) for r in se.facet_counts(
        df, {"category": F.col("categories"), "region": F.col("region")},
        {"active": se.active(F.col("status")), "unknown": F.col("status") == "DEADLINE_UNKNOWN"}).collect()}
    assert got[("category", "A")] == (1, 1) and got[("category", "B")] == (1, 0)
    se.write_result(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
