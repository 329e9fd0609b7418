import re

from pyspark.sql import functions as F

from noticemill.functions.patterns import needed_words, word_gate
from noticemill.operators.classify import MEDICAL, classify, generic_candidate, opaque_candidate, priority_groups
from noticemill.operators.quality import category_candidates

from .helpers import notices

GROUPS = {
    "Supply of ICU ventilators": ["VENTILATORS"],
    "High flow nasal cannula machine HFNC": ["VENTILATORS"],
    "Portable ultrasound machine": ["ULTRASOUND"],
    "Colour doppler": ["ULTRASOUND"],
    "AED for cardiac resuscitation": ["DEFIBRILLATORS"],
    "ICU beds": ["HOSPITAL_BEDS"],
    "Emergency stretcher trolley": ["HOSPITAL_BEDS"],
    "Video laryngoscope": ["ENDOSCOPY"],
    "Laparoscopic instruments": ["ENDOSCOPY"],
    "Digital mamography system": ["MAMMOGRAPHY"],
    "Mobile DR system": ["DIGITAL_RADIOGRAPHY"],
    "C-arm machine": ["C_ARM"],
    "Syringe infusion pumps": ["INFUSION_PUMPS"],
    "Multipara monitors": ["PATIENT_MONITORS"],
    "Blood and fluid warmer": ["PATIENT_WARMING"],
    "OT light with battery backup": ["OT_LIGHTS"],
    "Anaesthesia workstation": ["ANAESTHESIA"],
    # Not a priority group.
    "Flooring in ventilator room": [],
    "Fetal doppler": [],
    "C-arm compatible table": [],
    "Electrocautery for laparoscopic procedures": [],
    "OT light batteries": [],
    "Ventilator simulator": [],
    "Laser doppler flowmeter": [],
    "Baggage x-ray scanner": [],
    "Laboratory microscope": [],
}


def test_priority_groups(spark):
    df = notices(spark, *[{"title": t} for t in GROUPS])
    got = {r.title: r.priority_categories for r in priority_groups(df).collect()}
    assert got == GROUPS


def test_scope_and_context(spark):
    rows = [
        ({"title": "Civil works", "description": "flooring of ventilator room", "work_category": "Civil Works"}, False),
        ({"title": "ICU ventilators including electrical wiring", "work_category": "Civil"}, True),
        ({"title": "Supply of items", "description": "Supply of ventilators", "product_category": "Electrical"}, True),
        ({"title": "Wiring", "description": "electrical wiring in CT scanner block"}, False),
        ({"title": "Admission notice radiography course", "description": "x-ray"}, False),
        ({"title": "Department of Radiology", "description": "Buyer: X-ray department"}, False),
        ({"title": "Central monitor", "product_category": "Medical Equipments/Waste"}, True),
        ({"title": "Central monitor for CCTV network", "description": "patient"}, False),
        ({"title": "PET-CT scanner"}, True),
    ]
    df = notices(spark, *[r for r, _ in rows])
    text = F.concat_ws("\n", "title", "description")
    out = classify(df, text, F.col("title"), out="c").orderBy("ordinal").collect()
    assert [r.c.is_relevant for r in out] == [ok for _, ok in rows]
    assert out[8].c.categories == ["DIAGNOSTIC_IMAGING"]
    assert out[6].c.matched_keywords == ["central monitor"] and out[6].c.confidence == 0.76


def test_brand_matches(spark):
    titles = {
        "Samsung ultrasound": {"Samsung Healthcare": "explicit-brand"},
        "HAMILTON-C6 ventilator": {"Hamilton Medical": "explicit-brand", "Skanray": "portfolio"},
        "CT scanner": {},
        "Mobile CT": {"Samsung Healthcare": "portfolio"},
        "Spy-glass endoscopy": {},
        "Hospital furniture": {"LINET": "portfolio"},
        "Nebulizer": {},
        "Breathing circuit": {"Hamilton Medical": "portfolio"},
        "C-MAC laryngoscope": {"KARL STORZ": "explicit-model", "Medcaptain": "portfolio"},
        "Sprint timer": {},
        "Laboratory microscope": {},
    }
    df = notices(spark, *[{"title": t} for t in titles])
    out = classify(df, F.col("title"), out="c", brands=True).collect()
    assert {r.title: {m.brand: m.match_type for m in r.c.brand_matches} for r in out} == titles


def test_generic_and_opaque_candidates(spark):
    chain = {"source_id": "punjab-phsc", "region": "Punjab", "organisation": "Punjab Health Systems Corporation||Medical Wing"}
    rows = [
        ({"title": "ICU equipment"}, True, False),
        ({"title": "Central Monitor"}, True, False),
        ({"title": "ICU equipment and civil repair"}, False, False),
        ({"title": "Medical equipment", "work_category": "Civil Works"}, False, False),
        ({"title": "PHSC/2026/12", **chain}, True, True),
        ({"title": "Supply of various items", **chain}, True, True),
        ({"title": "CAMC of medical equipment", **chain}, True, True),
        ({"title": "PHSC/2026/12", **chain, "description": "drugs"}, False, False),
        ({"title": "PHSC/2026/12", **{**chain, "region": "Haryana"}}, False, False),
        ({"title": "PHSC/2026/12", **{**chain, "organisation": "Punjab Health Systems Corporation||Engineering Wing||Medical Wing"}}, False, False),
    ]
    df = notices(spark, *[r for r, _, _ in rows])
    got = df.select("ordinal", generic_candidate(df), opaque_candidate(df)).orderBy("ordinal").collect()
    assert [(r[1], r[2]) for r in got] == [(g, o) for _, g, o in rows]


def test_category_candidates_union(spark):
    rows = spark.createDataFrame(
        [(1, "s", "fetal doppler", [], True), (2, "s", "ventilator", ["VENTILATORS"], True), (3, "s", "road", [], False)],
        "notice_key int, source_id string, evidence string, priority_categories array<string>, is_relevant boolean",
    )
    got = {(r.notice_key, r.grp, r.is_confirmed) for r in category_candidates(rows).collect()}
    assert got == {(1, "ULTRASOUND", False), (2, "VENTILATORS", True)}


def test_words_that_every_match_holds():
    """Texts without them skip the evidence steps and all rules."""
    assert needed_words(r"\b(?:c[ -]?arms?|ct scan\w*|pa?ediatric bed)\b") == {
        ("arm", True), ("carm", True), ("scan", True), ("ediatric", False)}
    assert needed_words(r"\b(?:e[ck]g|holter)\b") is not None and needed_words(r"\b(?:\d+|holter)\b") is None
    assert word_gate([r"\bx\b", r"\d"]) is None and word_gate([]) is None
    for text, groups in GROUPS.items():
        assert not groups or re.search(MEDICAL.words, text, re.I), text
    hits = 0
    for pattern in [p for _, p in MEDICAL.taxonomy]:
        for text in ["X-Ray", "xrays", "c arm", "CARMS", "ultra sound", "2 slice ct", "ECG", "pulse oximeters", "paediatric beds", "AED defibrillator", "Central monitors"]:
            if re.search(pattern, text, re.I):
                hits += 1
                assert re.search(word_gate([pattern]), text, re.I), (pattern, text)
    assert hits >= 8
    assert not re.search(MEDICAL.words, "charm, hexrays and other flooring", re.I)


def test_words_split_by_removed_text_still_count(spark):
    """Rooms, marks and sections that evidence leaves out may bring the parts of a phrase together."""
    rows = ["patient\x01 monitor", "ven\x01tilator", "ICU ward beds", "central\nICU room\nmonitor for patients", "pet ct", "plain"]
    t = spark.createDataFrame(list(enumerate(rows)), "i int, text string")
    c = classify(t, F.col("text"), brands=True).orderBy("i").collect()
    assert [r.classification.is_relevant for r in c][:2] == [True, True]
    assert c[5].classification.asDict() == {
        "categories": [], "matched_keywords": [], "confidence": 0.0, "is_relevant": False, "brand_matches": []}
