import random
import zlib
from math import log2

import numpy as np
import pytest

from noticemill.llm.language_id import FOLD_CASE, build_trees, languages, windows

from .cases import CLASHES, LONG, empty, table

WORDS = {
    "en": "the of and that which with house water tree would there being thought known shall".split(),
    "fr": "le la et que dans une être été maison eau arbre où ceux pensée connu serait".split(),
    "de": "der die und dass welche mit haus wasser baum würde dort gewesen gedanke größe".split(),
}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n)).capitalize() + "."


def labelled(spark, rows):
    values = [(i, t, lang, None, None, *["clash"] * len(CLASHES.split())) for i, t, lang in rows]
    return spark.createDataFrame(values, table(spark, []).schema)


def corpus(seed=1, n=240):
    rng = random.Random(seed)
    return [(i, sentence(rng, lang := rng.choice(sorted(WORDS)), rng.randint(4, 60)), lang) for i in range(n)]


def held_out(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 0


def counts(texts, order):
    found = [{} for _ in range(order + 1)]
    for t in texts:
        t = b"\n" + t.translate(FOLD_CASE)
        for i in range(1, len(t)):
            for k in range(min(order, i) + 1):
                w = t[i - k : i + 1]
                found[k][w] = found[k].get(w, 0) + 1
    return found


def plain_bits(found, text, order):
    """Escape by escape, from dictionaries."""

    def chance(context, symbol):
        k = len(context)
        own = {w[-1:]: n for w, n in found[k].items() if w[:-1] == context}
        total, kinds = sum(own.values()), len(own)
        if k == 0:
            return own[symbol] / (total + kinds) if symbol in own else kinds / (total + kinds) / (256 - kinds)
        if not own:
            return chance(context[1:], symbol)
        if symbol in own:
            return own[symbol] / (total + kinds)
        left = 1 - sum(chance(context[1:], s) for s in own)
        return kinds / (total + kinds) * chance(context[1:], symbol) / left

    t = b"\n" + text.translate(FOLD_CASE)
    return -sum(log2(chance(t[max(0, i - order) : i], t[i : i + 1])) for i in range(1, len(t)))


def trees_of(per_lang, order):
    counted = []
    for texts in per_lang.values():
        found = counts(texts, order)
        keys = [{int.from_bytes(w, "big"): n for w, n in f.items()} for f in found]
        counted.append([(np.array(sorted(f), np.uint64), np.array([f[x] for x in sorted(f)], float)) for f in keys])
    return build_trees(list(per_lang), counted)


@pytest.mark.parametrize("order", [0, 1, 3])
def test_code_lengths_are_those_of_escape_by_escape(order):
    rng = random.Random(2)
    per_lang = {lang: [sentence(rng, lang, 12).encode() for _ in range(6)] for lang in sorted(WORDS)}
    trees = trees_of(per_lang, order)
    texts = [b"", b"x", b"The House", "été où \x00\xff".encode("latin-1"), sentence(rng, "de", 9).encode(), b"\n\n the"]
    expected = [[plain_bits(counts(own, order), t, order) for own in per_lang.values()] for t in texts]
    assert np.allclose(trees.lengths(texts), expected, rtol=1e-4, atol=1e-3)


def test_chances_of_all_symbols_sum_to_one():
    rng = random.Random(3)
    per_lang = {"en": [sentence(rng, "en", 30).encode()], "fr": [sentence(rng, "fr", 30).encode()]}
    trees = trees_of(per_lang, 3)
    for context in (b"", b"th", b"the", b"zzz", b"e m"):
        ends = trees.lengths([context + bytes([s]) for s in range(256) if not 65 <= s <= 90])
        more = trees.lengths([context + bytes([s]) for s in range(97, 123)])  # upper case is scored as lower case
        before = trees.lengths([context])
        upper = trees.lengths([context + bytes([s]) for s in range(65, 91)])
        assert (upper == more).all()
        unseen = np.exp2(-8.0 * 0)  # symbols A-Z never occur, so their share is left over
        total = np.exp2(before - ends).sum(axis=0)
        assert (total <= unseen + 1e-4).all() and (total > 0.9).all()


def test_windows_are_the_same_in_blocks(monkeypatch):
    texts = [b"abcdef", b"", b"Xy", b"0123456789" * 5]
    whole = [np.concatenate(x) for x in zip(*windows(texts, 4))]
    monkeypatch.setattr("noticemill.llm.language_id.BLOCK", 7)
    parts = [np.concatenate(x) for x in zip(*windows(texts, 4))]
    for text, window, before, t2, w2, b2 in zip(*whole, *parts):
        keep = (1 << (8 * (min(int(before), 4) + 1))) - 1
        assert (text, before, int(window) & keep) == (t2, b2, int(w2) & keep)
    assert len(whole[0]) == sum(map(len, texts))


def test_held_out_accuracy(spark):
    rows = corpus()
    found = languages(labelled(spark, rows).repartition(3)).collect()
    truth = {i: lang for i, _, lang in rows}
    assert len(found) == len(rows) and all(0 < r.score <= 1 and r.held_out == held_out(r.doc_id) for r in found)
    unseen = [r for r in found if r.held_out]
    assert len(unseen) > 30 and sum(r.lang_pred == truth[r.doc_id] for r in unseen) / len(unseen) > 0.97


def test_a_smaller_sample_and_split_do_not_change_rows(spark):
    df = labelled(spark, corpus())
    one, other = (sorted(map(tuple, languages(d, fit_bytes=4000).collect())) for d in (df.coalesce(1), df.repartition(5)))
    assert one == other


def test_held_out_labels_and_other_columns_teach_nothing(spark):
    rows = corpus()
    changed = [(i, t, "xx" if held_out(i) else lang) for i, t, lang in rows]
    assert sorted(map(tuple, languages(labelled(spark, rows)).collect())) == sorted(
        map(tuple, languages(labelled(spark, changed)).collect())
    )


def test_awkward_rows(spark):
    rows = corpus() + [(1000, None, "en"), (1001, "", "fr"), (1002, "12 -- ?! \n", "en"), (None, "the house", "de")]
    rows += [(1003, "the water", None), (1003, "the water", None), (LONG, "où été", "fr"), (1004, "Ω", None)]
    rows += [(1005, "the house would being " * 40_000, "en"), (1006, "ª", None)]
    found = {}
    for r in languages(labelled(spark, rows)).collect():
        found.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert found[1000] == found[1001] == found[1002] == [("und", 0.0)]
    assert [p for p, _ in found[1003]] == ["en", "en"] and found[None][0][0] == "en" and found[LONG][0][0] == "fr"
    assert found[1005][0][0] == "en" and found[1004][0][0] in WORDS and found[1006][0][0] in WORDS
    assert {p for v in found.values() for p, _ in v} <= {*WORDS, "und"}


def test_no_labels_and_empty_table(spark):
    rows = labelled(spark, [(1, "the house", None), (2, None, "en")])
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in languages(rows).collect()) == [(1, "und", 0.0), (2, "und", 0.0)]
    assert languages(empty(spark)).collect() == []
