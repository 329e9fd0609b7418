import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticemill.llm.top_k import search, top_k

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, score string, salt string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, None, "a", "b", "c") for i, v in rows], SCHEMA)


def brute(rows, queries, k):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(1024 * float(np.float32(x))) for x in v]

    data = [(i, whole(v)) for i, v in rows if i is not None and whole(v) is not None]
    asked = {}
    for i, v in queries:
        if i is not None and whole(v) is not None:
            asked[i] = min(asked.get(i, whole(v)), whole(v))
    out = []
    for q, x in asked.items():
        scores = sorted(((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in data if i != q and len(y) == len(x)))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def vectors(seed=0, n=700, dim=8):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    v[n // 3 : n // 2] = v[5]  # many equal vectors: ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(100, None), (101, [1.0] * (dim - 1) + [None]), (102, [float("nan")] * dim), (103, [float("inf")] * dim)]
    return rows + [(None, v[0].tolist()), (200, v[0].tolist()), (7, v[1].tolist()), (9000, [0.5, 0.25]), (9001, [1.0, -1.0]), (-100, v[2].tolist())]


@pytest.mark.parametrize("sizes", [(512, 8192, 64), (3, 50, 7)])
def test_matches_brute_force(spark, sizes):
    rows = vectors()
    df = table(spark, rows).repartition(3)
    found = top_k(df, df.filter("vec_id % 100 = 0"), 10, *sizes)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, [r for r in rows if r[0] is not None and r[0] % 100 == 0], 10)


def test_huge_components():
    q = np.array([[2**40, -(2**40)]], np.int64)
    v = np.array([[2**40, 1], [1, -(2**41)], [0, 0]], np.int64)
    scores, ids, valid = search(q, np.array([5, 6, 7]), v, np.array([1]), 2, 1)
    assert ids.tolist() == [[6, 5]] and [int(s) for s in scores[0]] == [2**40 + 2**81, 2**80 - 2**40]


def test_fewer_than_k_and_empty(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5])]
    df = table(spark, rows)
    assert [tuple(r) for r in top_k(df, df.filter("vec_id = 0")).collect()] == [(0, 1, 1, 1024 * 512 + 2048 * 512)]
    none = df.filter(F.lit(False))
    assert top_k(none, none).collect() == []


def test_pruning_skips_blocks(monkeypatch):
    """Clustered ranges: whole blocks stay below the kth score and are never scored."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 10
    v = np.floor(1024 * np.repeat(centres, 64, axis=0) + rng.normal(size=(40 * 64, 16))).astype(np.int64)
    own = np.array([10**6])
    best, ids, _ = search(v[:1] * 1, np.arange(len(v)), v, own, 5, 64)
    exact = sorted(zip((-(v[:1] @ v.T)[0]).tolist(), range(len(v)), strict=True))[:5]
    assert [(-int(s), int(i)) for s, i in zip(best[0], ids[0], strict=True)] == exact
