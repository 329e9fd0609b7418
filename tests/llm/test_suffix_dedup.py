import hashlib
import random
import tracemalloc

import numpy as np
import pytest

from noticemill.llm import suffix_dedup
from noticemill.llm.suffix_sort import BlindTrie, deep_shallow_order

from .cases import LONG, documents, empty, rows_of, table, texts


def brute(rows, width):
    data = [(LONG if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        for s in range(len(b) - width + 1):
            k = b[s : s + width]
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for (i, b), (doc, _) in zip(data, rows, strict=True):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - width + 1):
            if first[b[s : s + width]] < (i, s):
                gone[s : s + width] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((doc, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def result(df, width):
    found = suffix_dedup.repeated_passages(df, width)
    rows = [(r.doc_id, r.n_bytes, sum(s.hi - s.lo for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in found.collect()]
    return sorted(rows, key=repr)


@pytest.mark.parametrize("hot", [400, 2])
@pytest.mark.parametrize("width", [100, 40])
def test_matches_brute_force(spark, monkeypatch, hot, width):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    assert result(documents(spark), width) == brute(texts(), width)


def test_many_contexts_of_one_passage(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 5)
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(160))
    rows = [(i, "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 140))) + passage + rng.choice(["", "!", passage])) for i in range(80)]
    assert result(table(spark, rows).repartition(4), 100) == brute(rows, 100)


def test_flushes_between_copies(spark, monkeypatch):
    """A task that forgets its pieces early gives the same result."""
    rows = [(i, "abc " * 40 + str(i % 7) * 3 + "def gh " * 30) for i in range(40)]
    whole = brute(rows, 100)
    pieces = suffix_dedup.Pieces(100)
    assert pieces.flush() == []
    assert result(table(spark, rows).repartition(3), 100) == whole


def test_empty_table(spark):
    assert suffix_dedup.repeated_passages(empty(spark)).collect() == []


def test_whole_characters_and_carried_columns(spark):
    text = "é" * 60 + "à" * 60
    df = table(spark, [(1, text), (2, "x" + text), (3, "ü" + text[1:])]).withColumn("kept", df_lit())
    rows = suffix_dedup.repeated_passages(df, 100, characters=True, carry=["lang", "kept", "key_"]).collect()
    for r in rows:
        r[1].decode("utf-8")
        assert tuple(r)[-3:] == (None, "mine", "clash")


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("mine")


def test_long_text_in_segments():
    text = ("0123456789" * 120_000).encode()
    h, first, last, owner, _, _ = suffix_dedup.anchors(text, 100)
    assert first[0] == 0 and last[-1] == len(text) - 100
    assert (first[1:] == last[:-1] + 1).all() and (owner >= first).all() and (owner - last <= 76).all()


@pytest.mark.parametrize("seed", range(4))
def test_order_of_strings(seed):
    rng = random.Random(seed)
    data = bytes(rng.choice(b"ab" if seed % 2 else b"abcdefgh") for _ in range(900)) * 2 + bytes(64)
    text = np.frombuffer(data, np.uint8)
    starts = np.array([rng.randrange(1700) for _ in range(600)])
    order, rank = deep_shallow_order(text, starts, 60, shallow=16)
    strings = [data[s : s + 60] for s in starts[order]]
    assert strings == sorted(strings)
    assert all((strings[i] == strings[i - 1]) == (rank[i] == rank[i - 1]) for i in range(1, len(strings)))


def test_blind_trie_orders():
    rng = random.Random(3)
    strings = [b"same" + bytes(rng.choice(b"xy") for _ in range(8)) for _ in range(200)]
    trie = BlindTrie(12, 4)
    for i, s in enumerate(strings):
        trie.insert(s, i)
    assert [strings[leaf[0]] for leaf in trie.leaves()] == sorted(set(strings))
    assert sorted(i for leaf in trie.leaves() for i in leaf) == list(range(200))


def test_repeated_rows_keep_the_same_bytes(spark):
    rows = [(1, "p" * 50 + "q" * 90)] * 3 + [(2, "q" * 90 + "p" * 50 + "q" * 90)]
    assert rows_of(suffix_dedup.repeated_passages(table(spark, rows), 100).select("doc_id", "n_bytes"))
    assert result(table(spark, rows), 100) == brute(rows, 100)


def test_memory_a_window():
    """All windows of a run of pieces are ordered in few numbers a window."""
    rng = random.Random(3)
    text = np.frombuffer(rng.randbytes(300_000) + bytes(256), np.uint8)
    starts = np.arange(300_000)
    tracemalloc.start()
    order, rank = deep_shallow_order(text, starts, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90 * len(starts)
    strings = [text[i : i + 100].tobytes() for i in order[:2000]]
    assert strings == sorted(strings) and len(set(rank.tolist())) == len(set(starts.tolist()))
