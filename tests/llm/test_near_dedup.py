import random

import pytest
from pyspark.sql import functions as F

from noticemill.llm import near_dedup
from noticemill.llm.components import components
from noticemill.llm.near_dedup import MinMax, near_duplicates

from .cases import LONG, WORDS, documents, empty, sentence, table, texts


def shingles(text):
    words = [w.lower() for w in (text or "").encode().split()]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows, percent):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                group[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        doc = LONG if doc is None else doc
        least[find(i)] = min(least.get(find(i), LONG), doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        c = least[find(i)]
        out.append((doc, len(sets[i]), None if c == LONG else c, c == (LONG if doc is None else doc)))
    return sorted(out, key=repr)


def result(df, percent):
    return sorted((tuple(r) for r in near_duplicates(df, percent).collect()), key=repr)


@pytest.mark.parametrize("percent", [80, 85])
def test_matches_brute_force(spark, percent):
    assert result(documents(spark), percent) == brute(texts(), percent)


def families(seed, n=4, members=25, edits=6):
    """Groups of edited copies whose links form chains as well as stars."""
    rng = random.Random(seed)
    rows = []
    for f in range(n):
        last = sentence(rng, 150).split()
        for m in range(members):
            words = list(last)
            for _ in range(rng.randint(0, edits)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            rows.append((1000 * f + rng.randrange(1000), " ".join(words)))
            if rng.random() < 0.4:
                last = words
    return list({i: (i, t) for i, t in rows}.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_families_of_edited_copies(spark, monkeypatch, seed):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rows = families(seed)
    assert result(table(spark, rows).repartition(3), 80) == brute(rows, 80)


def test_documents_that_share_a_passage_stay_apart(spark):
    rng = random.Random(8)
    shared = sentence(rng, 60)
    rows = [(i, shared + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))) for i in range(60)]
    assert result(table(spark, rows), 80) == brute(rows, 80)


def test_missing_a_band_is_unlikely():
    for t in (0.8, 0.85, 0.9):
        m = MinMax(t)
        assert (1 - t**m.rows) ** (2 * m.half) < 1e-6 and 2 * m.half * m.rows <= near_dedup.VALUES


def test_sketch_agreement_estimates_similarity():
    import numpy as np

    m = MinMax(0.8)
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 1000, np.uint64)
    a, b = np.sort(pool[:900]), np.sort(pool[100:])
    x, y = (np.frombuffer(m(s)[1], np.uint8) for s in (a, b))
    assert abs((x == y).mean() - 0.8) < 0.1


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(500, 400)]
    found = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, 400: 400, 500: 400}


def test_empty_table(spark):
    assert near_duplicates(empty(spark)).collect() == []
    assert near_duplicates(documents(spark).filter(F.col("text").isNull())).count() == 2


def around(template, copies, seed):
    """Copies of one text with up to five words of their own, so many lie just beyond the threshold of all others."""
    rng = random.Random(seed)
    rows = []
    for i in range(copies):
        words = template.split()
        for k in range(i % 6):
            words[rng.randrange(len(words))] = f"own{i}x{k}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_copies_around_a_text(spark, percent, monkeypatch):
    rows = around(sentence(random.Random(5), 120), 90, 6)
    kept = []
    linkable = near_dedup._linkable

    def counted(met, *others):
        found = linkable(met, *others).persist()
        kept.append((met.select("node").distinct().count(), found.select("node").distinct().count()))
        return found

    monkeypatch.setattr(near_dedup, "_linkable", counted)
    assert result(table(spark, rows), percent) == brute(rows, percent)
    [(met, found)] = kept
    assert found < met  # copies with too many words of their own meet nobody
