import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from noticemill.llm import lm_scoring as lm

from .cases import documents, empty, table, texts


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def brute(rows):
    held = [zlib.crc32((str(i) if i is not None else "").encode()) % 5 == 1 for i, _ in rows]
    counts = Counter(t for (_, x), h in zip(rows, held, strict=True) if not h for t in tokens(x))
    n = sum(counts.values())
    z = n + 0.5 * (len(counts) + 1)
    return sorted(
        (
            (i, h, len(tokens(x)), sum(t in counts for t in tokens(x)), n, round(sum(math.log10((counts[t] + 0.5) / z) for t in tokens(x)), 6))
            for (i, x), h in zip(rows, held, strict=True)
        ),
        key=repr,
    )


def result(df, **more):
    rows = lm.lm_scores(df, lm.is_held_out(), **more).collect()
    for r in rows:
        assert r.score <= 0 and math.isfinite(r.score)
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=repr), {
        (r.doc_id, r.n_tokens): r.score for r in rows
    }


def test_base_matches_brute_force(spark):
    base, _ = result(documents(spark))
    assert base == brute(texts())


def test_parts_and_rare_words_give_the_same(spark):
    base, scores = result(documents(spark))
    again, parts = result(documents(spark), filter_bytes=64, frequent_words=3)
    assert base == again
    assert all(abs(scores[k] - parts[k]) < 1e-9 for k in scores)


def test_no_plan_holds_two_parts(spark):
    rng = np.random.default_rng(1)
    parts = []
    for _ in range(3):
        words = lm.filter_slice(rng.integers(0, 2**63, 50, np.uint64), np.ones(50, np.int64))
        parts.append(spark.sparkContext.broadcast((words.tobytes(), np.array([len(words)]).tobytes())))

    def then(batch, lo, hi, found):
        return pa.RecordBatch.from_arrays([pa.array(found.sizes)], names=["n"])

    df = lm._probed(table(spark, [(1, "a b"), (2, "c")]), parts, then, "n long", [])
    assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted(r.n for r in df.collect()) == [2, 3]


def test_beats_the_base_on_held_out_text(spark):
    import random

    rng = random.Random(3)
    follow = {w: [rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(3)] for w in [a + b for a in "abcdefghij" for b in "klmnop"]}
    rows = []
    for i in range(300):
        w, out = "ak", []
        for _ in range(80):
            w = rng.choice(follow[w])
            out.append(w)
        rows.append((i, " ".join(out)))
    found = lm.lm_scores(table(spark, rows).repartition(3), lm.is_held_out()).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > 0.75 * found[1]  # less negative


def test_levels_are_never_too_low():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 5000, np.uint64)
    counts = np.maximum(1, rng.pareto(0.7, 5000)).astype(np.int64)
    words = lm.filter_slice(h, counts)
    found = lm.Filter(words.tobytes(), np.array([len(words)]).tobytes()).levels(h)
    true = lm.level_of(counts)
    assert (found >= true).all() and (found == true).mean() > 0.9
    missing = lm.Filter(words.tobytes(), np.array([len(words)]).tobytes()).levels(rng.integers(0, 2**63, 5000, np.uint64))
    assert (missing > 0).mean() < 0.1


def test_level_counts_stay_near_the_count():
    counts = np.arange(1, 5000)
    means = lm.level_counts()[lm.level_of(counts)]
    assert (np.abs(means - counts) <= 0.34 * counts).all()


def test_empty_tables(spark):
    assert result(empty(spark))[0] == []
    held = [(i, "some words here") for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows, _ = result(table(spark, held))
    assert all(r[1] and r[3] == 0 and r[4] == 0 for r in rows) and len(rows) == len(held)
