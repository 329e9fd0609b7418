"""SentencePiece encoding and decoding through a table of distinct marked words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_texts, documents

MARK = "▁"


class MarkedWords:
    """Ids of texts by their marked words, each segmented once while the table remembers it.

    A marked word is a run of word marks with the characters up to the next mark.  No piece of the vocabulary holds a
    mark after another character (checked on opening), so merges never cross the start of a marked word and its ids
    are the same alone and inside a text.
    """

    def __init__(self, path: str, most: int = 400_000, longest: int = 80):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.library.id_to_piece, range(self.library.vocab_size()))
        if any(MARK in piece.lstrip(MARK) for piece in pieces):
            raise ValueError("pieces of this vocabulary cross word marks")
        self.most, self.longest = most, longest
        self.lone = np.uint32([self.library.piece_to_id(MARK)]).tobytes()
        self.table: dict[str, bytes] = {}
        self.ends = np.uint32([self.library.bos_id()]).tobytes(), np.uint32([self.library.eos_id()]).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = np.asarray(self.library.encode(word), np.uint32).tobytes() if word else self.lone
        if len(word) <= self.longest:
            if len(self.table) >= self.most:
                self.table.clear()
            self.table[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Little-endian ids with begin and end; ``word`` is the marked word without its first mark."""
        if not text:
            return b"".join(self.ends)
        text = text.replace(MARK, " ")  # a mark in the text is a space to the library
        if "  " in text or text[0] == " " or text[-1] == " ":
            words = [found[1:] for found in re.findall(r" +[^ ]*", " " + text)]
        else:
            words = text.split(" ")
        table, missing = self.table, self.__missing__
        out = [table.get(word) or missing(word) for word in words]
        return b"".join((self.ends[0], *out, self.ends[1]))

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, np.uint32).tolist())


def encode(docs: DataFrame, model: str, **table: int) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers, begin and end included.

    Null and empty texts give begin and end only.  Every row gives one row; other columns are ignored; one pass
    without a shuffle, with a table of at most ``most`` distinct marked words in each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = MarkedWords(model, **table)
        for batch in batches:
            ids = [words.encode(text) for text in as_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, ids binary"
    )


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = MarkedWords(model)
        for batch in batches:
            texts = [words.decode(ids or b"") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_digests(docs: DataFrame, model: str, **table: int) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): both directions in one pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = MarkedWords(model, **table)
        for batch in batches:
            counts, ids_sums, text_sums = [], [], []
            for text in as_texts(batch.column(1)):
                ids = words.encode(text)
                counts.append(len(ids) // 4)
                ids_sums.append(hashlib.sha256(ids).hexdigest())
                text_sums.append(hashlib.sha256(words.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(ids_sums, pa.string()),
                    pa.array(text_sums, pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))
