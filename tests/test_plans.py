import hashlib
import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from noticemill.operators.quality import category_audit, category_candidates, group_table
from noticemill.plans.dashboard import audit_evidence, build_dashboard, candidate_flags

from .helpers import notices, now
from .test_entities import directory
from .test_selection import brute_round_robin

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["order_status_summary", "order_fair_selection", "part_facets", "event_latest_records", "order_feed_items", "document_topics", "supplier_offices"]


def test_dashboard_end_to_end(spark):
    rows = [
        {"id": "1", "tender_id": "T1", "title": "Supply of ICU ventilators", "organisation": "GMC Patiala", "region": "Punjab"},
        {"id": "2", "tender_id": "T1", "title": "Supply of ICU ventilators", "organisation": "GMC Patiala", "region": "Punjab", "source_id": "s2", "description": "turbine"},
        {"id": "3", "title": "Ultrasound", "procurement_scope": "statewide", "region": "Punjab"},
        {"id": "4", "title": "Flooring", "organisation": "GMC Patiala", "region": "Punjab"},
        {"id": "5", "title": "Ultrasound", "organisation": "Nowhere"},
    ]
    d = build_dashboard(notices(spark, *rows), directory(spark), now())
    s = d.summary.collect()[0]
    assert (s.raw_records, s.institution_matched, s.medical_relevant, s.duplicates_removed) == (5, 3, 3, 1)
    assert (s.false_positives_rejected, s.unassigned_rejected, s.active_likely) == (1, 1, 2)
    out = {r.title: r for r in d.merged.survivors.collect()}
    v = out["Supply of ICU ventilators"]
    assert v.institution_id == "gmc-patiala" and v.description == "turbine" and v.priority_categories == ["VENTILATORS"] and len(v.id) == 20
    evidence = audit_evidence(d.raw)
    docs = spark.createDataFrame([], "notice_key bigint, ordinal int, url string, label string, doc_type string, doc_status string, text_method string")
    flags = candidate_flags(d.merged.survivors, now()).withColumn("extraction_status", F.lit(None).cast("string"))
    audit = {r.grp: r for r in category_audit(category_candidates(evidence), flags, docs, group_table(spark)).collect()}
    assert audit["VENTILATORS"].raw_candidates == 2 and audit["ULTRASOUND"].raw_candidates == 2 and audit["VENTILATORS"].active_likely == 1


def test_contract_shape(spark):
    q, o = contract.queries(), contract.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 45
    assert contract.entry(spark).count() == 5


@pytest.mark.parametrize("gone", [["llm"], ["llm", "corpus_pipeline.py"]])
def test_entry_without_the_optional_parts(tmp_path, gone):
    root = os.path.dirname(os.path.abspath(contract.__file__))
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(*gone, "tests", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, check=True).stdout
    for line, every in zip(out.splitlines(), (contract.queries(), contract.oracle_sql()), strict=True):
        assert line.split() == sorted(n for n in every if n != "pipeline" and not n.startswith("op"))


@pytest.mark.parametrize("name", SAMPLE)
def test_sample_queries_match_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{FOLDER}/{f}'")
    df = contract.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    result = con.execute(contract.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == cols
    mine = sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.select(*cols).collect())
    wanted = sorted(repr([round(r[names.index(c)], 6) if isinstance(r[names.index(c)], float) else r[names.index(c)] for c in cols]) for r in result.fetchall())
    assert mine == [w.replace("Decimal", "") for w in wanted]


def test_section_texts_match_sql(spark):
    test_sample_queries_match_sql(spark, "document_section_texts")


def test_section_texts_read_every_line(spark, tmp_path):
    texts = ["Bed\nWarranty\na\nProduct specification\nb", "Bed\nlast", None, "Bed\nlast"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    wanted = {
        0: "Bed\nProduct specification\nb\nTechnical Specifications\nBed\nProduct specification\nb",
        1: "Item specification\nBed\nlast",
        2: None,
        3: "Bed\nlast",
    }
    rows = contract.queries()["document_section_texts"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.evidence_sha256 for r in rows} == {i: t and hashlib.sha256(t.encode()).hexdigest() for i, t in wanted.items()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = con.execute(contract.oracle_sql()["document_section_texts"]).fetchall()
    assert sorted(found) == sorted((r.doc_id, r.evidence_chars, r.evidence_sha256) for r in rows)


def test_rotated_selection_matches_the_replay(spark):
    out = contract.queries()["order_fair_rotated"](spark, FOLDER).collect()
    o = spark.read.parquet(f"{FOLDER}/orders.parquet").orderBy("o_orderkey").collect()
    for s in range(12):
        rows = [(r.o_orderkey, [r.o_orderpriority] + (["EXTRA"] if r.o_orderkey % 3 == 0 else [])) for r in o if r.o_custkey % 12 == s]
        groups = {g for _, names in rows for g in names}
        got = [r.notice_key for r in sorted(out, key=lambda r: r.position) if r.source_id == f"s-{s}"]
        assert got == brute_round_robin(rows, 16, dict.fromkeys(groups, 5))
