import pytest
from pyspark.sql import functions as F

from noticemill.functions import dates, deadlines, identifiers, patterns, text, urls
from noticemill.sources import medical_rules as rules

from .helpers import values


def test_listing_dates(spark):
    days = ["01-10-2026", "01/10/2026", "01.10.2026", "01-Oct-2026", "01 October 2026", "2026-10-01"]
    assert values(spark, days, lambda c: dates.parse_listing_date(c, True)) == ["2026-10-01T23:59:59+05:30"] * 6
    timed = {
        "01/10/2026 15:00": "2026-10-01T15:00:00+05:30",
        "01-Oct-2026 03:00 PM": "2026-10-01T15:00:00+05:30",
        "01-Oct-2026 12:00 AM": "2026-10-01T00:00:00+05:30",
        "01-Oct-2026 12:00 PM": "2026-10-01T12:00:00+05:30",
        "01-Oct-2026 13:00 PM": None,
        "2026-10-01T15:00:00Z": "2026-10-01T15:00:00Z",
        "2026-10-01T15:00:00+99:99": None,
        "2026-10-01T15:00:00+14:30": None,
        "2026-10-01T15:00:00+14:00": "2026-10-01T15:00:00+14:00",
        "31-Feb-2026": None,
        "29-Feb-2028": "2028-02-29T00:00:00+05:30",
        "01-01-1999": None,
        "NA": None,
        "--": None,
        "": None,
        " 01 Oct 2026 ": "2026-10-01T00:00:00+05:30",
    }
    assert values(spark, list(timed), dates.parse_listing_date) == list(timed.values())


def test_three_readings_of_a_bare_day(spark):
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    assert values(spark, ["2026-10-01"], lambda c: iso(dates.instant(c))) == ["2026-10-01T00:00:00.000"]
    assert values(spark, ["2026-10-01"], lambda c: iso(dates.deadline_instant(c))) == ["2026-10-01T18:29:59.999"]
    assert values(spark, ["2026-10-01T10:00"], lambda c: iso(dates.instant(c))) == ["2026-10-01T04:30:00.000"]
    assert values(spark, ["soon", "2026-10-01T10"], dates.instant) == [None, None]


def test_deadline_display(spark):
    shown = ["2026-10-07", "2026-10-07T08:30:00Z", None, "bad-date"]
    assert values(spark, shown, lambda c: dates.deadline_display(c, F.lit("minute"))) == [
        "07 Oct 2026 · Time not confirmed", "07 Oct 2026, 02:00 pm IST", "Deadline unknown", "Deadline unknown",
    ]


def test_wall_clock_dates(spark):
    assert values(spark, ["2026-10-05T15:00:00Z", "2026-10-05T15:00:00.000Z", "2026-10-05"], dates.wall_clock_date) == [
        "2026-10-05T15:00:00+05:30", "2026-10-05T15:00:00+05:30", None,
    ]


@pytest.mark.parametrize(
    "label",
    ["Bid End Date/Time", "Bid Submission End Date", "Submission deadline", "Closing date & time", "Last date",
     "Last date for submission of bids", "Due date", "End date", "Revised closing date"],
)
def test_labelled_deadline_variants(spark, label):
    got = values(spark, [f"{label}: 01-Oct-2026 03:00 PM"], deadlines.submission_deadline)[0]
    assert (got.date, got.date_precision) == ("2026-10-01T15:00:00+05:30", "minute")


def test_labelled_deadline_rules(spark):
    cases = {
        "Last date: 01-10-2026, Time: 03:00 PM": "2026-10-01T15:00:00+05:30",
        "Last date: 01-10-2026, Time: 12:00 AM": "2026-10-01T00:00:00+05:30",
        "Bid End Date/Time/बिड बंद होने की तारीख/समय\n01-10-2026 15:00:00": "2026-10-01T15:00:00+05:30",
        "Closing date 01-10-2026\nRevised closing date: 05-10-2026 10:00": "2026-10-05T10:00:00+05:30",
        "Due date 01-10-2026 and end date 02-10-2026": None,
        "Due date 01-10-2026 and end date 01-10-2026": "2026-10-01T23:59:59+05:30",
        "Warranty period end date: 01-10-2026": None,
        "Document sale end date: 01-10-2026": None,
        "Dated 01-10-2026": None,
    }
    got = values(spark, list(cases), lambda c: deadlines.submission_deadline(c)["date"])
    assert got == list(cases.values())
    assert values(spark, ["Closing date soon", "delivery end date soon"], deadlines.has_deadline_label) == [True, False]


def test_url_policy(spark):
    cases = {
        "https://x.gov.in/a.pdf": "https://x.gov.in/a.pdf",
        "https://X.GOV.IN:443": "https://x.gov.in/",
        "http://x.gov.in/a.pdf": None,
        "https://evilgov.in/": None,
        "https://gmc.edu.in.evil.com/": None,
        "https://user@x.gov.in/": None,
        "https://x.gov.in:8443/": None,
        "file:///etc/passwd": None,
        "https://10.0.0.1/": None,
    }
    assert values(spark, list(cases), urls.official_url) == list(cases.values())
    base = F.lit("https://x.gov.in/dir/page.html")
    assert values(spark, ["file.pdf", "/a", "//y.nic.in/b"], lambda c: urls.official_url(c, base)) == [
        "https://x.gov.in/dir/file.pdf", "https://x.gov.in/a", "https://y.nic.in/b",
    ]
    assert values(
        spark,
        ["https://x.gov.in/app?component=DirectLink_1&session=T", "https://x.gov.in/app?component=docDownoad", "/api/documents/bfuhs/12"],
        urls.public_link,
    ) == [None, None, "/api/documents/bfuhs/12"]
    assert values(spark, ["https://a.gov.in/x.PDF", "https://a.gov.in/x?bidId=3", "https://a.gov.in/tender/7", "https://a.gov.in/list"],
                  urls.specific_document) == [True, True, True, False]


def test_identifiers(spark):
    assert values(spark, ["GEM / 2026 / B / 12, gem/2026/b/12 and 2026_ABC_1_2"], identifiers.notice_ids) == [["GEM/2026/B/12", "2026_ABC_1_2"]]
    agree = lambda c: identifiers.identity_agrees(F.lit("GEM/2026/B/12"), c)
    assert values(spark, ["GEM/2026/B/12", "GEM/2026/B/13", "none"], agree) == [True, False, True]
    assert values(spark, ["E-Tender Notice No. PI(EP)/25-26/G/14/03", "PI(EP)/25-26/14"], identifiers.item_reference) == ["PI(EP)/25-26/G/14/03", None]
    assert values(spark, ["PI (EP) 25-26 / 14 notice"], identifiers.batch_reference) == ["PI(EP)/25-26/14"]
    assert values(spark, ["Medical & Dental  College (Civil)"], identifiers.alias_key) == ["medical and dental college civil"]


def test_product_evidence_sections(spark):
    plain = "Ventilator\nTerms and Conditions\nadmin x\nTechnical Specifications\nTurbine"
    assert values(spark, [plain, "Warranty\n5 years", "one line"], text.product_evidence) == [
        "Ventilator\nTechnical Specifications\nTurbine", "", "one line",
    ]
    bid = (
        "Bid Number: GEM/2026/B/1\nBid Details\nICU Ventilator\n123\nItem Category\nTurbine type\n"
        "Minimum Average turnover\nX-ray in office\nTechnical Specifications\nMonitor\nBuyer Added Bid Specific\nCT scan"
    )
    got = values(spark, [bid], text.product_evidence)[0]
    assert "ICU Ventilator" in got and "Turbine type" in got and "Monitor" in got
    assert "X-ray" not in got and "CT scan" not in got and "turnover" not in got


def test_display_and_feed_text(spark):
    assert values(spark, ["a\u0007 % b", "N/A", "%%", None], text.display_text) == ["a b", "", "", ""]
    assert values(spark, ["intro Technical Specification rest"], text.description_excerpt) == ["intro"]
    assert values(spark, ["<b>Bed</b> 2 > 1", "  "], text.plain_text) == ["Bed 2 › 1", None]
    assert values(spark, ["5", "0", "2.5", "1000001", None], text.whole_quantity) == [5, None, None, None, None]
    assert values(spark, ["ACTIVE_LIKELY"], text.label_text) == ["Active Likely"]
    kinds = [("Corrigendum 1", ""), ("BOQ", ""), ("Technical bid", ""), ("Notice", "https://x/y.xlsx"), ("Notice", "https://x/y.pdf")]
    df = spark.createDataFrame(kinds, "l string, u string").coalesce(1)
    got = [r[0] for r in df.select(text.document_type(F.col("l"), F.col("u"))).collect()]
    assert got == ["corrigendum", "boq", "technical-specification", "boq", "tender-document"]
    assert values(spark, ["Organisation Name / Health Dept Office Name Block 2 Contact details"],
                  lambda c: text.field_between(c, "Organisation Name", "Office Name")) == ["Health Dept"]


def test_pattern_dialect(spark):
    assert values(spark, ["éct scan", "ct scan", "act scan"], lambda c: patterns.matches(c, r"\bct scan\b")) == [True, True, False]
    assert values(spark, ["a b"], lambda c: patterns.matches(c, r"a\sb")) == [True]
    assert values(spark, ["end\n"], lambda c: patterns.matches(c, r"end$")) == [False]
    dropped = patterns.without_lookaheads(r"\b(?:x(?!\s+(?:a|b)\b)|[()]y(?=z))\b")
    assert dropped == r"\b(?:x|[()]y)\b"


def test_rule_tables_are_complete():
    assert len(rules.TAXONOMY) == 35 and len(rules.PORTFOLIOS) == 7
    assert len(rules.PRIORITY_GROUPS) == 13 and len(rules.CLAUSE_RULES) == 34 and len(rules.SECTIONS) == 11


def test_dates_offer_only_digits_to_casts(spark):
    texts = spark.createDataFrame([("05-Sep-2026 03:00 PM",), ("05-September-2026",), ("5/9/2026 15:00",)], "t string")
    df = texts.select(dates.parse_listing_date(F.col("t")).alias("d"))
    assert [r.d for r in df.collect()] == ["2026-09-05T15:00:00+05:30", "2026-09-05T00:00:00+05:30", "2026-09-05T15:00:00+05:30"]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan.upper() and "^[0-9]+$" in plan
