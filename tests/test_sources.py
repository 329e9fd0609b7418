import json

from pyspark.sql import functions as F

from noticemill.functions.identifiers import surrogate_key
from noticemill.sources import html, listings


def pages(spark, *rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id int, url string, html string").coalesce(1)


def scanned(spark, *rows):
    p = pages(spark, *rows)
    return html.scan_rows(p).join(p.select("page_id", "url"), "page_id")


def tr(*cells, tag="td"):
    return "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in cells) + "</tr>"


PORTAL = "https://etenders.gov.in/eprocure/app"


def test_portal_listing_and_details(spark):
    link = '<a href="/eprocure/app?page=FrontEndViewTender&sp=1&session=T">[ICU Ventilator]</a> [REF/1] [2026_ABC_12_1]'
    page = "<table>" + tr("1", "01-Sep-2026 09:00 AM", "01-Oct-2026 03:00 PM", "02-Oct-2026 03:00 PM", link + " [x]", "Health||Wing") \
        + tr("2", "bad", "01-Oct-2026", "", link, "Other") + tr("3", "a", "b", "c", "no link 2026_ABC_13_1", "d") + tr("x") + "</table><!-- <tr><td>c</td></tr> -->"
    rows = scanned(spark, (PORTAL, page)).withColumn("source_id", F.lit("portal"))
    got = listings.portal_listing(rows).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.tender_id, r.title, r.reference_number) == ("2026_ABC_12_1", "ICU Ventilator", "2026_ABC_12_1")
    assert r.tender_url == "https://etenders.gov.in/eprocure/app?page=FrontEndViewTender&sp=1"
    assert r.original_closing_date == "2026-10-01T15:00:00+05:30" and r.organisation_chain == ["Health", "Wing"]
    detail = "<table>" + tr("Tender ID", "2026_ABC_12_1") + tr("Title", "ICU Ventilator, turbine", "Product Category", "Medical Equipments/Waste") \
        + tr("Title", "second") + tr("Work Description", "Supply") + tr("Bid Submission End Date", "05-Oct-2026 05:00 PM") + tr("Tender Status", "Cancelled") + "</table>" \
        + '<table id="corrigendumDocumenttable">' + tr("1", "Date extension", "Extend", '<a href="/eprocure/app?c=1&session=T">v</a>') + "</table>"
    other = "<table>" + tr("Tender ID", "2026_ZZZ_1_1") + "</table>"
    drows = scanned(spark, (PORTAL, detail), (PORTAL, other), (PORTAL, "<p>expired</p>"))
    wanted = spark.createDataFrame([(0, "2026_ABC_12_1"), (1, "2026_ABC_12_1"), (2, "2026_ABC_12_1")], "page_id int, tender_id string")
    fields = wanted.join(listings.detail_fields(drows, listings.PORTAL_LABELS), "page_id", "left")
    good, bad = listings.enrich_details(listings.portal_listing(rows), fields, drows)
    g = good.collect()[0]
    assert g.title == "ICU Ventilator, turbine" and g.description == "Supply Medical equipment procurement category"
    assert g.original_closing_date == "2026-10-05T17:00:00+05:30" and g.cancelled and g.verification == "detail"
    assert [(a.title, a.url) for a in g.amendments] == [("Date extension", "https://etenders.gov.in/eprocure/app?c=1")]
    assert {(b.page_id, b.reason) for b in bad.collect()} == {(1, "detail-of-another-notice"), (2, "detail-missing")}


def test_amendment_page(spark):
    ok = "<p>Published Corrigendum Details</p><table>" + tr("Tender ID :", "2026_ABC_12_1") + tr("v", "03-Sep-2026 05:00 PM") \
        + tr("Bid Submission End Date", "09-Oct-2026 05:00 PM") + "</table><p>Details Before Corrigendum</p><table>" + tr("Bid Submission End Date", "01-Oct-2026 05:00 PM") + "</table>"
    p = pages(spark, (PORTAL, ok), (PORTAL, ok), (PORTAL, "<p>nothing</p>")).withColumn("tender_id", F.when(F.col("page_id") == 1, "X").otherwise("2026_ABC_12_1"))
    scan = lambda q: html.scan_rows(q)
    good, bad = listings.amendment_pages(p, scan)
    g = good.collect()
    assert len(g) == 1 and g[0].revised_closing_date == "2026-10-09T17:00:00+05:30" and g[0].published_date == "2026-09-03T17:00:00+05:30"
    assert {b.page_id for b in bad.collect()} == {1, 2}


def test_nine_columns(spark):
    url = "https://www.aiimsbilaspur.edu.in/procurement/tender/gem"
    docs = '<ul><li><a href="/x.pdf">Notice</a></li><li><a href="/c.pdf">Corrigendum extension</a> Published Date: 05-09-2026</li><li><a href="http://evil/x.pdf">bad</a></li></ul>'
    page = tr("1", "GEM / 2026 / B / 77", "Spine system", "d", "01-09-2026", "01-10-2026", "", docs, "") \
        + tr("2", "-", "Early", "d", "10-09-2026", "01-09-2026", "31-31-2026", "", "") + tr("3", "r", "Late", "d", "01-09-2026", "10-09-2026", "05-09-2026", "", "withdrawn") + tr("short")
    rows = listings.nine_column_listing(scanned(spark, (url, f"<table>{page}</table>")), ["aiimsbilaspur.edu.in"]).orderBy("row").collect()
    a, b, c = rows
    assert a.tender_id == "GEM/2026/B/77" and len(a.documents) == 2 and a.date_precision == "day"
    assert [(x.type, x.published_date[:10]) for x in a.corrigenda] == [("extension", "2026-09-05")] and "review" in a.notes[0]
    assert b.original_closing_date is None and b.reference_number is None and any(n == "closes-before-publication" for n in b.notes) and any("unreadable-extension" in n for n in b.notes)
    assert c.extended_closing_date is None and c.withdrawn and not c.cancelled


def test_layouts_and_office(spark):
    u = "https://www.aiimsbathinda.edu.in/p"
    six = "<table>" + tr("1", "GEM/2026/B/5", "Bed", "01-09-2026", "01-10-2026", '<a href="/d.pdf">Corrigendum</a><a href="/d.doc">x</a>') \
        + tr("2", "bad id", "Bed", "01-09-2026", "01-10-2026", "") + "</table>"
    four = "<table>" + tr("12", "01-09-2026", "Notice", "") + tr("x", "01-09-2026", "Notice", "") + "</table>"
    rows = scanned(spark, (u, six), (u, four)).withColumn("source_id", F.when(F.col("page_id") == 0, "aiims-bathinda").otherwise("bfuhs"))
    got = {r.source_id: r for r in listings.layout_listing(rows, listings.layout_table(spark)).collect()}
    assert len(got) == 2 and got["bfuhs"].id == "bfuhs-12" and got["bfuhs"].procurement_scope == "statewide"
    assert got["aiims-bathinda"].tender_id == "GEM/2026/B/5" and len(got["aiims-bathinda"].documents) == 1 and len(got["aiims-bathinda"].corrigenda) == 1
    office = "<table>" + tr("1", "RO Ludhiana", '<a href="/a.pdf">Pump GEM/2026/B/9</a>', "01-09-2026", "01-10-2026", "R1") + tr("2", "RO Delhi", "x", "01-09-2026", "", "") + tr("3", "Ludhiana", "x", "bad", "", "") + "</table>"
    o = listings.office_listing(scanned(spark, ("https://esic.gov.in/tenders", office)), "Ludhiana").collect()
    assert [(r.tender_id, r.tender_url) for r in o] == [("GEM/2026/B/9", "https://esic.gov.in/a.pdf")]


def test_notice_board(spark):
    u = "https://pgimer.edu.in/list"
    link = '<a href="/X/TENDER_VIEW.jsp?tenderId={}">{}</a>'
    page = "<table>" + tr("1", link.format(7, "Old"), "01-10-2026", "Purchase") + tr("2", link.format(8, "Cancellation Notice"), "01-10-2026 15:00", "Works") \
        + tr("3", link.format(7, "Beds"), "02-10-2026", "Purchase") + tr("4", '<a href="/other.jsp?tenderId=9">x</a>', "", "") + "</table>"
    board = listings.board_listing(scanned(spark, (u, page)), "pgimer.edu.in")
    got = {r.board_id: r for r in board.collect()}
    assert set(got) == {"7", "8"} and got["7"].title == "Beds" and got["8"].cancelled and got["8"].date_precision == "minute"
    pdf = "/PGIMER_PORTAL/AbstractFilePath?PathKey=TENDER_PATH&FileType=E&FileName={}"
    d7 = "<table>" + tr("Tender Title :", "beds") + tr("Status", "x") + tr("Status", "Cancelled") + tr("Last date of submission", "05-10-2026 15:00") + "</table>" \
        + f'<a href="{pdf.format("a.pdf")}">Notice</a><a href="{pdf.format("b.pdf")}">Corrigendum</a><a href="{pdf.format("a.doc")}">x</a>'
    d8 = "<table>" + tr("Tender Title", "another") + "</table>"
    p = spark.createDataFrame([("7", d7), ("8", d8)], "board_id string, html string").coalesce(1)
    good, bad = listings.board_details(board, html.scan_rows(p, "board_id"), html.scan_links(p, "board_id"), "pgimer.edu.in")
    g = {r.board_id: r for r in good.collect()}
    assert g["7"].cancelled and g["7"].original_closing_date == "2026-10-05T15:00:00+05:30" and [x.label for x in g["7"].documents] == ["Notice", "Corrigendum"] and len(g["7"].corrigenda) == 1
    assert [b.board_id for b in bad.collect()] == ["8"] and g["8"].verification == "listing"
    flags = spark.createDataFrame([("E-Tender Notice PI(EP)/25-26/G/14", "Purchase"), ("E-Tender Notice", "Purchase")], "t string, c string").coalesce(1)
    assert [r[0] for r in flags.select(listings.is_batch_notice(F.col("t"), F.col("c"))).collect()] == [True, False]


def test_batch_items_with_ditto_dates(spark):
    head = "E-Tender Notice No. PI(EP)/25-26/G/14\nPostgraduate Institute of Medical Education and Research, Chandigarh\nDate: 30-08-2026\nEquipment / Item Name | Bid submission Date"

    def row(n, date, name="Bed", qty="2 Nos"):
        return f"{n}. | {name} | {qty} | emd | {date} | open | Dept"

    lines = [row(1, "01-10-2026"), row(2, "-do-"), row(3, "unreadable"), row(4, "do"), row(5, "02-10-2026"), row(5, "09-10-2026"), "6. | broken", row(7, "-do-"),
             row(8, "03-10-2026"), row(101, "04-10-2026"), row(9, "-do-"), row(10, "05-10-2026", qty="many"), row(11, "06-10-2026")]
    p = spark.createDataFrame([(1, 0, 1, head + "\n" + "\n".join(lines[:6])), (1, 1, 2, "\n".join(lines[6:])), (2, 0, 1, head)],
                              "notice_key int, page_ordinal int, page int, text string")
    titles = spark.createDataFrame([(1, "Notice PI (EP) 25-26 / G / 14"), (2, "Notice PI(EP)/25-26/15")], "notice_key int, title string")
    got = {r.number: (r.original_closing_date or "")[8:10] for r in listings.batch_items(p, titles).collect()}
    assert got == {1: "01", 2: "01", 3: "", 4: "", 5: "02", 7: "", 8: "03", 9: "", 11: "06"}
    one = listings.batch_items(p, titles).filter("number = 2").collect()[0]
    assert one.reference_number == "PI(EP)/25-26/G/14/02" and one.publish_date == "2026-08-30T00:00:00+05:30" and one.page == 1


def test_search_pages(spark):
    def doc(**k):
        return {"b_bid_number": ["GEM/2026/B/12"], "b_id": ["9"], "b_category_name": ["ICU &amp; <b>Bed</b>"], "bd_category_name": "Beds",
                "b_bid_type": [1], "b_status": [1], "final_end_date_sort": ["2026-10-05T15:00:00Z"], "ba_official_details_deptName": ["Health"], **k}

    good = {"code": 200, "response": {"response": {"numFound": 1, "start": 0, "docs": [doc(), doc(b_id="10", b_bid_type=[2], b_eval_type=[1], b_status=["5"])]}}}
    bad = {"code": 200, "response": {"response": {"numFound": 1, "start": 0, "docs": [doc(b_id=["x"])]}}}
    empty, odd = {"status": 0, "code": 404, "message": "No data found"}, {"status": 0, "code": 404, "message": "No data found", "x": 1}
    p = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate([good, bad, empty, odd])] + [(4, "not json")], "page_id int, json string").coalesce(1)
    totals, docs, quarantine = listings.search_page(p)
    assert {(r.page_id, r.total) for r in totals.collect()} == {(0, 1), (2, 0)}
    assert {r.page_id for r in quarantine.collect()} == {1, 3, 4}
    a, b = listings.search_records(docs.orderBy("doc_ordinal")).collect()
    assert a.title == "ICU & Bed" and a.description == "Beds" and a.extended_closing_date == "2026-10-05T15:00:00+05:30" and not a.cancelled
    assert a.tender_url.endswith("/showbidDocument/9") and b.tender_url.endswith("/list-ra-schedules/10") and b.documents == [] and b.cancelled


def test_links_keys_and_union(spark):
    u = "https://a.gov.in/page"
    page = '<table><tr><td>Annexure</td><td><a href="s.pdf">first</a></td></tr></table><a href="/s.pdf">second</a><a href="/get?id=1">Download specification</a><a href="/x.html">x</a>'
    got = {r.doc_url: r.label for r in html.linked_documents(pages(spark, (u, page))).collect()}
    assert got == {"https://a.gov.in/s.pdf": "second", "https://a.gov.in/get?id=1": "Download specification"}
    links = spark.createDataFrame([(1, i, f"l{i}", f"https://a.gov.in/{i % 14}.pdf") for i in range(20)] + [(1, 99, "z", "https://b.com/z.pdf")], "page_id int, ordinal int, label string, url string")
    kept = html.document_policy(links).orderBy("position").collect()
    assert len(kept) == 12 and kept[0].label == "l14" and kept[-1].label == "l11"
    a = spark.createDataFrame([("T1", "x")], "tender_id string, title string")
    b = spark.createDataFrame([("s", "t")], "source_id string, title string")
    rows = listings.notice_key(listings.union_notices(a, b)).collect()
    want = spark.range(1).select(surrogate_key(F.lit("T1")), surrogate_key(F.lit("s||t||"))).collect()[0]
    assert {r.id for r in rows} == set(want)


def test_plain_pages_scan_like_any_other():
    plain = '<table id="t"><tr><td>a &amp; b</td><td><a href="/x?p=1&amp;q=2">L<li>i</a></li></td></tr><TR><th>h</TH><td>2'
    assert html._plain_parts(plain) is not None
    for other in ("<br/>", "<!-- -->", "<a href=x>", "a < b", "<script>", "</td x>", '<a href="&copy">'):
        assert html._plain_parts(other) is None
    parsed = html._scan(plain + "<!-- -->")
    read = html._scan(plain)
    assert repr((read.rows, read.links)) == repr((parsed.rows, parsed.links)) and read.links[0]["href"] == "/x?p=1&q=2"


def test_many_pages_share_a_batch_and_keep_their_columns(spark):
    link = '<a href="/{}.pdf">l</a>'
    p = pages(spark, *[(f"https://a.gov.in/{i}", link.format(i) * (i % 3)) for i in range(300)], ("https://a.gov.in/n", None))
    links = html.scan_links(p, carry=["url"])
    assert sorted((r.page_id, r.url[17:], r.ordinal, r.href) for r in links.collect()) == sorted(
        (i, str(i), n, f"/{i}.pdf") for i in range(300) for n in range(i % 3)
    )
    batches = links.mapInArrow(lambda it: (b.slice(0, 1).select(["page_id"]) for b in it if b.num_rows), "page_id int")
    assert batches.count() == 1
    rows = html.scan_rows(pages(spark, (PORTAL, "<table>" + tr("a") + "</table>")), carry=["url"]).collect()
    assert [(r.url, r.row, r.n_cells, r.cells[0].text) for r in rows] == [(PORTAL, 0, 1, "a")]


def test_link_addresses_are_worked_out_once(spark):
    plan = html.linked_documents(pages(spark, (PORTAL, "")))._jdf.queryExecution().optimizedPlan().toString()
    assert sum("^(?i)[a-z][a-z0-9+.\\-]*:" in line for line in plan.splitlines()) == 1
