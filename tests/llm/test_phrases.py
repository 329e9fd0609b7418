import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticemill.llm.phrases import SIDE, collocations, tile_counts, word_sequence

from .cases import empty, table, texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=2000, percent=100):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            ws = tuple(re.findall("[^\x20\x09]+", piece))
            n[lang] += len(ws)
            for m in range(1, 6):
                for i in range(len(ws) - m + 1):
                    f[lang, ws[i : i + m]] += 1
    found = {k: c for k, c in f.items() if len(k[1]) > 1 and c >= least}
    covered = set()
    for (lang, ws), c in found.items():
        for i in range(len(ws)):
            for j in range(i + 2, len(ws) + 1):
                if j - i < len(ws) and 100 * c >= percent * found[lang, ws[i:j]]:
                    covered.add((lang, ws[i:j]))
    out = {}
    for (lang, ws), a in found.items():
        if (lang, ws) not in covered:
            cuts = ((f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws)))
            score, _, lo, hi = min((1000 * a * n[lang] // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
            out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), lo, hi))
    return sorted(
        (lang, rank, p.decode(), -a, lo, hi, n[lang], -s)
        for lang, rows in out.items()
        for rank, (s, a, p, lo, hi) in enumerate(sorted(rows)[:top], 1)
    )


def with_lang(spark, rows):
    df = table(spark, [(None, t) for _, t in rows]).withColumn("n_", F.monotonically_increasing_id())
    langs = spark.createDataFrame([(lang,) for lang, _ in rows], "lang string").withColumn("n_", F.monotonically_increasing_id())
    return df.coalesce(1).drop("lang").join(langs.coalesce(1), "n_")


def prose(seed=3, n=300):
    rng = random.Random(seed)
    phrases = ["New York city", "a\tb c d e f", "of the", "été à la", "x y", "zeta,eta theta", "in front of the"]
    words = "the of a b x y New York ü 12 -- <b> 'tis".split()
    out = []
    for i in range(n):
        parts = [rng.choice(phrases) if rng.random() < 0.5 else rng.choice(words) for _ in range(rng.randint(0, 60))]
        text = "".join(p + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "\r\n"]) for p in parts)
        out.append((rng.choice(["en", "en", "en", "fr", None, "und"]), text))
    return out + [("fr", None), (None, ""), ("en", " \t\n"), ("de", "alone"), ("en", out[0][1]), ("en", out[0][1])]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("least, run_bytes, broadcast", [(20, 8 << 20, 1 << 20), (5, 300, 0), (5, 2000, 3000), (200, 2000, 1 << 20)])
def test_matches_brute_force(spark, least, run_bytes, broadcast):
    """Levels of ids reach the tasks by broadcast, by joins, or the first by joins and the last by broadcast."""
    rows = prose()
    expected = brute(rows, least)
    found = collocations(with_lang(spark, rows).repartition(3), least, run_bytes=run_bytes, broadcast_bytes=broadcast)
    assert rows_of(found) == expected
    assert (len(expected) > 20) == (least < 100)


def test_top_ties_and_share_of_covering(spark):
    rows = prose(8)
    assert rows_of(collocations(with_lang(spark, rows), 5, top=7)) == brute(rows, 5, top=7)
    assert rows_of(collocations(with_lang(spark, rows), 5, covered_percent=60)) == brute(rows, 5, percent=60)


def test_awkward_rows_and_long_text(spark):
    rows = [("en", t) for _, t in texts()] + [("en", "x" * 50_000), ("en", "so it goes " * 60_000), ("en", "a b. " * 50_000)]
    assert rows_of(collocations(with_lang(spark, rows), 3, run_bytes=4000)) == brute(rows, 3)


def test_empty_table(spark):
    assert collocations(empty(spark)).collect() == []


def test_scores_beyond_64_bits(spark):
    exact = spark.sql(
        "SELECT (CAST(1000 AS DECIMAL(38, 0)) * a * n) div (CAST(l AS DECIMAL(38, 0)) * r) AS s "
        "FROM VALUES (40000000000003L, 9999999999999999L, 40000000000009L, 40000000000003L) t(a, n, l, r)"
    ).first().s
    assert exact == 1000 * 40000000000003 * 9999999999999999 // (40000000000009 * 40000000000003)


def test_tiles_agree_with_plain_counts():
    rng = np.random.default_rng(1)
    left = np.concatenate([rng.integers(0, 40, 200_000), rng.zipf(1.3, 50_000) % (30 * SIDE), [2**40, 2**40]])
    right = np.concatenate([rng.integers(0, 300, 200_000), rng.zipf(1.2, 50_000) % (30 * SIDE), [2**41, 5]])
    a, b, n, code = tile_counts(left, right)
    assert {(x, y): c for x, y, c in zip(a.tolist(), b.tolist(), n.tolist())} == Counter(zip(left.tolist(), right.tolist()))
    assert len(a) == len(set(zip(a.tolist(), b.tolist())))
    assert (a[code] == left).all() and (b[code] == right).all()
    assert [len(x) for x in tile_counts(left[:0], right[:0])] == [0, 0, 0, 0]


def test_breaks_stand_between_pieces():
    seq, words, counts = word_sequence(b"\n\na b\n\n a \nc\n")
    assert [w.as_py() for w in words] == [b"a", b"b", b"c"]
    assert seq.tolist() == [0, 1, -1, 0, -1, 2] and counts.tolist() == [2, 1, 1]
    assert word_sequence(b"")[0].tolist() == word_sequence(b" \n")[0].tolist() == []
