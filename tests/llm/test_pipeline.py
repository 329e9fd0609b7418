import random

import corpus_pipeline
from noticemill.llm.catalogue import ORACLE, QUERIES

from . import test_line_dedup, test_near_dedup, test_suffix_dedup
from .cases import sentence


def tables(spark, folder, n=80):
    rng = random.Random(12)
    rows, labels = [], []
    boiler = sentence(rng, 20)
    for i in range(n):
        text = "\n".join(" ".join(rng.choice("alpha beta gamma delta été zeta".split()) + rng.choice("abc") for _ in range(12)) for _ in range(rng.randint(2, 6)))
        junk = i % 6 == 0
        if junk:
            text = " ".join(w + "###" for w in text.split())
        elif i % 5 == 0:
            text = boiler + "\n" + text
        if i % 10 == 7:
            text = rows[-3][1] + " end"
        rows.append((i, text, "en", "src", len(text)))
        labels.append((i, int("###" not in text), 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, labels


def test_each_stage_matches_its_brute_force(spark, tmp_path):
    rows, labels = tables(spark, str(tmp_path))
    docs = corpus_pipeline.documents(spark, str(tmp_path))
    good = {i for i, q, _ in labels if q}
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        if number < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            after = sorted((r.doc_id, r.text) for r in docs.collect())
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        if number == 0:
            assert len({i for i, _ in after} ^ good) <= 2
        if number == 1:
            assert after == sorted((i, t) for i, t, _, _ in test_line_dedup.brute(before))
        if number == 2:
            kept = {r[0] for r in test_near_dedup.brute(before, 80) if r[3]}
            assert after == sorted(r for r in before if r[0] in kept)
        if number == 3:
            brute = test_suffix_dedup.brute(before, 100)
            removed = sum(len(t.encode()) for _, t in before) - sum(len(t.encode()) for _, t in after)
            bytes_removed = sum(r[2] for r in brute)
            assert bytes_removed - 6 * sum(r[3] for r in brute) <= removed <= bytes_removed
        if number == 4:
            assert {r.doc_id for r in docs.collect()} == {i for i, _ in after}


def test_run_gives_the_last_stage(spark, tmp_path):
    tables(spark, str(tmp_path), 40)
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_each_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)
