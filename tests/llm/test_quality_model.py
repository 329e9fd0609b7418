import random
import zlib

import numpy as np

from noticemill.llm import quality_model as model

from .cases import WORDS, documents, empty, table, texts


def corpus(n=400, seed=6):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + rng.choice("ab") for _ in range(rng.randint(30, 120))]
        kind = rng.random()
        if kind < 0.1:
            words = [w + "###" for w in words]
        elif kind < 0.2:
            words = [x for w in words for x in (w, "|")]
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(kind >= 0.2), 0))
    return rows, labels


def label_table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    found = model.quality_scores(table(spark, rows).repartition(3), label_table(spark, labels)).collect()
    truth = {i: q for i, q, _ in labels}
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)


def test_held_out_labels_do_not_matter(spark):
    rows, labels = corpus(150)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    a, b = ({r.doc_id: r.score for r in model.quality_scores(table(spark, rows), label_table(spark, x)).collect()} for x in (labels, flipped))
    assert a == b


def test_awkward_rows(spark):
    _, labels = corpus(30)
    odd = [*labels, (None, 1, 0), (3, None, 0), (4, 0, 0), (10**9, 1, 1)]
    found = model.quality_scores(documents(spark), label_table(spark, odd)).collect()
    assert len(found) == len(texts()) and all(0 <= r.score <= 1 for r in found)
    none = label_table(spark, [])
    assert {r.score for r in model.quality_scores(documents(spark), none).collect()} == {0.5}
    assert model.quality_scores(empty(spark), none).collect() == []


def test_good_documents_keep_their_columns(spark):
    rows, labels = corpus(200)
    docs = table(spark, rows)
    good = model.good_documents(docs, label_table(spark, labels))
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    truth = {i for i, q, _ in labels if q}
    assert len(kept ^ truth) <= 4


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = model.fit_additive(x[:2000], y[:2000])
    assert ((m.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    assert (m.pairs[0][0], m.pairs[0][1]) == (1, 0)


def test_one_class_and_constant_features():
    x = np.ones((50, 3))
    m = model.fit_additive(x, np.ones(50))
    assert 0.9 < m.score(x)[0] < 1
    m = model.fit_additive(x, np.r_[np.ones(40), np.zeros(10)])
    assert 0.7 < m.score(x)[0] < 0.85
    assert len(model.FEATURES) == len(model.features(" ".join(WORDS).encode())) == len(model.features(b""))
