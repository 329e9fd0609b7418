from pyspark.sql import functions as F

from noticemill.operators import entities as en

from .helpers import notices

DIRECTORY = [
    ("pgimer", "PGIMER Institute", "PGIMER Chandigarh", "Chandigarh", "Chandigarh", ["PGIMER", "PGI Chandigarh"]),
    ("pgi-sangrur", "PGI Satellite Centre Sangrur", "PGI Sangrur", "Punjab", "Sangrur", ["PGI satellite Sangrur"]),
    ("pgi-una", "PGI Satellite Centre Una", "PGI Una", "Himachal Pradesh", "Una", []),
    ("gmc-patiala", "Government Medical College Patiala", "GMC Patiala", "Punjab", "Patiala", []),
    ("gmc-amritsar", "Government Medical College Amritsar", "GMC Amritsar", "Punjab", "Amritsar", []),
    ("phc-gharuan", "PHC Gharuan", "PHC Gharuan", "Punjab", "Gharuan", []),
]


def directory(spark):
    rows = [(*r, i) for i, r in enumerate(DIRECTORY)]
    return spark.createDataFrame(rows, "id string, name string, short_name string, region string, city string, aliases array<string>, ordinal int").coalesce(1)


def test_assignment(spark):
    cases = [
        ({"organisation": "Government Medical College, Patiala & Government Medical College Amritsar"}, ["gmc-patiala", "gmc-amritsar"]),
        ({"location": "Delivery Patiala Punjab"}, []),
        ({"title": "CHC Gharuan"}, []),
        ({"title": "PHC-Gharuan"}, ["phc-gharuan"]),
        ({"title": "PGIMER bed", "region": "Punjab"}, []),
        ({"title": "PGIMER bed", "region": "Punjab", "source_id": "cppp-pgimer"}, ["pgimer"]),
        ({"title": "PGIMER bed", "location": "Sangrur", "source_id": "cppp-pgimer"}, ["pgi-sangrur"]),
        ({"title": "PGIMER and PGI Una"}, ["pgi-una"]),
        ({"title": "PHC Gharuan", "institution_id": "gmc-patiala"}, ["gmc-patiala"]),
        ({"title": "PHC Gharuan", "institution_id": "unknown"}, ["phc-gharuan"]),
        ({"consignees": [(None, "GMC Amritsar")]}, ["gmc-amritsar"]),
        ({"title": "x", "procurement_scope": "statewide"}, []),
    ]
    out = en.assign_entities(notices(spark, *[c for c, _ in cases]), directory(spark)).orderBy("ordinal")
    rows = out.select("*", en.procurement_scope(F.col("matched")).alias("s"), en.attributed(F.col("matched"), F.col("procurement_scope")).alias("a")).collect()
    assert [[m.id for m in r.matched] for r in rows] == [w for _, w in cases]
    assert rows[0].s == "multi-institution" and rows[3].s == "institution" and rows[1].s == "statewide"
    assert [r.a for r in rows][-1] is True and rows[1].a is False


def test_regions(spark):
    cases = [
        ({"location": "Mullanpur, New Chandigarh"}, "Punjab"),
        ({"location": "Chandigarh"}, "Chandigarh"),
        ({"location": "Punjab and Haryana"}, None),
        ({"location": "New Delhi", "organisation": "GMC Patiala"}, None),
        ({"location": "Leh Ladakh"}, None),
        ({"location": "J & K"}, "Jammu and Kashmir"),
        ({"location": None, "title": "GMC Patiala bed"}, "Punjab"),
        ({"location": None, "title": "GMC Patiala and PGI Una"}, None),
        ({"location": None, "organisation": "PGI Una", "consignees": [(None, "GMC Patiala")]}, "Punjab"),
        ({"location": None}, None),
    ]
    out = en.resolve_region(notices(spark, *[c for c, _ in cases]), directory(spark)).orderBy("ordinal").collect()
    assert [r.resolved_region for r in out] == [w for _, w in cases]


DOC = """Ministry/State Name {state} Department Name {dept} Organisation Name {org} Office Name {office} Contact details x
GEM/2026/B/1 Bid Details
Item Category
ICU Ventilator
Consignees / Reporting Officer and Quantity {to} Technical Specifications"""


def doc(state="Punjab Government", dept="Department of Health Punjab", org="Civil Office", office="Block 2", to="store"):
    return DOC.format(state=state, dept=dept, org=org, office=office, to=to)


def test_buyer_enrichment_and_retention(spark):
    rows = [{"tender_id": "GEM/2026/B/1", "region": "Punjab", "department": "d"} for _ in range(4)]
    texts = [
        (0, doc(to="Government Medical College Patiala")),
        (1, doc(org="Directorate of Health Services", office="Punjab office")),
        (2, doc(org="Private trust hospital", office="Punjab")),
        (3, "GEM/2026/B/9 other bid"),
    ]
    docs = spark.createDataFrame(texts, "notice_key bigint, text string")
    got = en.enrich_buyer(notices(spark, *rows), docs, directory(spark))
    r = {x.notice_key: x for x in got.collect()}
    assert r[0].institution_id == "gmc-patiala" and "ICU Ventilator" in r[0].description
    assert r[1].procurement_scope == "statewide" and r[1].buyer.startswith("Directorate of Health Services")
    assert r[2].procurement_scope is None and r[2].document_checked and not r[3].document_checked
    kept = en.retain_regional(got.withColumn("has_document_text", F.lit(True))).select("notice_key", "procurement_scope").collect()
    assert {(k.notice_key, k.procurement_scope) for k in kept} == {(0, None), (1, "statewide")}


def test_delivery_regions_and_fan_out(spark):
    texts = [
        (0, doc(to="store at Haryana and Punjab")), (1, doc(to="Government Medical College Patiala")),
        (2, doc(to="Mumbai Maharashtra", office="Punjab")), (3, doc(to="main store", office="Uttarakhand office", org="o")),
        (4, doc(to="Mohali")),
    ]
    docs = spark.createDataFrame(texts, "notice_key bigint, text string")
    regions = en.locate_delivery(docs, directory(spark))
    assert {r.notice_key: r.regions for r in regions.collect()} == {
        0: ["Punjab", "Haryana"], 1: ["Punjab"], 2: [], 3: ["Uttarakhand"], 4: ["Punjab"],
    }
    fanned = en.fan_out_regions(notices(spark, *[{}] * 5), regions)
    assert fanned.count() == 5


def test_buyer_predicates_and_organisations(spark):
    names = ["Civil Surgeon Patiala", "GMC Patiala", "gmc patiala", "Animal Husbandry", "Private hospital", "Roads", "Punjab Health Systems Corporation"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, ordinal int")
    got = [r.name for r in en.select_organisations(df, directory(spark), "Punjab", True).collect()]
    assert got == ["GMC Patiala", "Civil Surgeon Patiala", "Punjab Health Systems Corporation"]
    d = spark.createDataFrame([("Health Department Punjab", "Punjab"), ("Health Department", "Punjab"), ("Health Department Chandigarh and Mohali", "Chandigarh")], "d string, r string").coalesce(1)
    assert [r[0] for r in d.select(en.regional_health_department(F.col("d"), F.col("r"))).collect()] == [True, False, False]
    chain = notices(spark, {"organisation": "Department of Health"}, {"organisation": "Veterinary hospital"}, {"organisation": "Roads"})
    flags = chain.select(en.buyer_chain(F.col("organisation"), F.col("organisation_chain"), F.array())).collect()
    assert [f[0] for f in flags] == [True, False, False]


def test_phrases_match_brute_force(spark):
    texts = [(i, " ".join(f"w{(i * j) % 7}" for j in range(1, 12))) for i in range(20)]
    phrases = [("a", "w1 w2"), ("b", "w3"), ("c", "W0-w0 w0"), ("d", "w5 w3 w1"), ("e", "w9")]
    t = spark.createDataFrame(texts, "notice_key int, text string")
    p = en.phrase_table(spark.createDataFrame(phrases, "id string, name string"), phrases=["name"], alias_col=None)
    want = {(k, i) for k, s in texts for i, ph in phrases if f" {ph.lower().replace('-', ' ')} " in f" {s} "}
    assert {(r.notice_key, r.entity_id) for r in en.match_phrases(t, p).collect()} == want


def test_directory_sources(spark):
    df = spark.createDataFrame([("a", "Punjab", ["s", "gem-direct-punjab"]), ("b", "Elsewhere", None)], "id string, region string, source_ids array<string>")
    got = {r.id: r.source_ids for r in en.with_region_sources(df).collect()}
    assert got == {"a": ["s", "gem-direct-punjab", "gem-priority-keywords"], "b": ["gem-priority-keywords"]}


def test_phrases_meet_texts_in_generated_code(spark):
    """A position's following words are put together after the join, which a lambda before it would prevent."""
    p = spark.createDataFrame([("one two three four", "e", 4), ("five", "f", 1)], "phrase string, entity_id string, words int")
    t = spark.createDataFrame([(1, "zero one two, three-four"), (2, "one two three"), (3, "Five"), (4, None), (5, "")], "notice_key long, text string")
    met = en.match_phrases(t, p)
    assert {(r.notice_key, r.entity_id) for r in met.collect()} == {(1, "e"), (3, "f")}
    assert "lambda" not in met._jdf.queryExecution().executedPlan().toString()
