import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from noticemill.llm import pieces

from .cases import documents, empty, texts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
WORDS = pieces.MarkedWords(MODEL, most=5)


def expected(text):
    ids = [LIBRARY.bos_id(), *LIBRARY.encode(text or ""), LIBRARY.eos_id()]
    return ids, LIBRARY.decode(ids)


def ids_of(data):
    return [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n\t▁é中😀.▁"), max_size=40))
def test_ids_are_the_librarys(text):
    assert ids_of(WORDS.encode(text)) == expected(text)[0]


@pytest.mark.parametrize("text", ["", " ", "  ", " a", "a ", "a  b", "▁", "▁▁a", "x" * 5000, "<s> </s>", "\x00"])
def test_edges(text):
    assert ids_of(WORDS.encode(text)) == expected(text)[0]
    assert WORDS.decode(WORDS.encode(text)) == expected(text)[1]


def test_table_both_ways(spark):
    encoded = pieces.encode(documents(spark), MODEL)
    rows = sorted((repr(r.doc_id), ids_of(r.ids)) for r in encoded.collect())
    assert rows == sorted((repr(i), expected(t)[0]) for i, t in texts())
    back = sorted((repr(r.doc_id), r.text) for r in pieces.decode(encoded, MODEL).collect())
    assert back == sorted((repr(i), expected(t)[1]) for i, t in texts())
    assert pieces.encode(empty(spark), MODEL).collect() == []
    assert pieces.encode_digests(empty(spark), MODEL).collect() == []


def test_digests(spark):
    import hashlib
    import struct

    found = sorted(tuple(r) for r in pieces.encode_digests(documents(spark).filter("doc_id IS NOT NULL"), MODEL).collect())
    wanted = []
    for i, t in texts():
        if i is not None:
            ids, text = expected(t)
            wanted.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert found == sorted(wanted)
