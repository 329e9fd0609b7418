"""Packing: token sequences of a fixed length by shortest-pack-first on the length histogram."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .common import as_texts, documents, id_key, original_id

#: White space that is neither space nor line feed.
OTHER_SPACE = re.compile("[\t\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
END_OF_TEXT = "<|endoftext|>"


class Encoder:
    """Byte-level ids, with a bounded table of words seen.

    A single space between two other characters always opens a token, so the parts before and from it have ids of
    their own.  Texts where white space meets a space, or that hold other white space or the special token, are
    encoded whole.
    """

    def __init__(self, ranks: str, most: int = 400_000, longest: int = 64):
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            pairs = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.library = tiktoken.Encoding(
            "ranks",
            pat_str=public_tokenizers.PATTERN,
            mergeable_ranks=pairs,
            special_tokens={END_OF_TEXT: len(pairs)},
        )
        self.most, self.longest, self.table = most, longest, {}

    def _missing(self, word: str) -> bytes:
        ids = np.asarray(self.library.encode_ordinary(word), np.uint32).tobytes()
        if len(word) <= self.longest:
            if len(self.table) >= self.most:
                self.table.clear()
            self.table[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if END_OF_TEXT in text:
            return np.asarray(self.library.encode(text, allowed_special="all"), np.uint32).tobytes()
        uneven = "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " "
        if uneven or OTHER_SPACE.search(text):
            return np.asarray(self.library.encode_ordinary(text), np.uint32).tobytes()
        first, *rest = text.split(" ")
        table, missing = self.table, self._missing
        return b"".join([table.get(w) or missing(w) for w in (first, *[" " + w for w in rest]) if w])


def token_pieces(docs: DataFrame, ranks: str, length: int = 1024, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens and, if kept, ids): documents as pieces of at most ``length``.

    A document is its ids followed by the end id; all its pieces but the last are full.  A null or empty text is its
    end id alone.  Every row gives its own pieces; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(ranks), np.uint32([end_id]).tobytes()
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), as_texts(batch.column(1)), strict=True):
                ids = encoder.encode(text) + end
                for start in range(0, len(ids), 4 * length):
                    piece = ids[start : start + 4 * length]
                    rows.append((key, start // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece))
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 6
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]]
            if keep_ids:
                arrays.append(pa.array(columns[5], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=NAMES[: len(arrays)])

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ddl)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]


def shortest_pack_first(histogram: dict[int, int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths, packs) that use up the histogram of piece lengths.

    Lengths are placed longest first, each into the packs with the most room left, and into new ones where none has
    room.  Works on counts: a step places a length into all packs of a pattern at once and splits at most one, so
    cost and number of patterns depend on ``length`` alone.
    """
    by_room: list[list[list]] = [[] for _ in range(length + 1)]
    for size in range(length, 0, -1):
        left = histogram.get(size, 0)
        room = length
        while left:
            while room >= size and not by_room[room]:
                room -= 1
            if room < size:
                per = length // size
                for pieces, packs in ((per, left // per), (left % per, 1)):
                    if pieces and packs:
                        by_room[length - pieces * size].append([(size,) * pieces, packs])
                break
            lengths, packs = by_room[room].pop()
            used = min(left, packs)
            if used < packs:
                by_room[room].append([lengths, packs - used])
            by_room[room - size].append([(*lengths, size), used])
            left -= used
    return [(lengths, packs) for patterns in by_room for lengths, packs in patterns]


def slot_table(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset), a row for each place that a pattern has for it."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for lengths, packs in patterns:
        offset = 0
        for size in lengths:
            slots.setdefault(size, []).append((ranks.get(size, 0), sequence, offset))
            ranks[size] = ranks.get(size, 0) + packs
            offset += size
        sequence += packs
    return {size: np.asarray(rows, np.int64) for size, rows in slots.items()}


def pack(pieces: DataFrame, length: int = 1024) -> DataFrame:
    """``pieces`` with sequence_id and offset: sequences of at most ``length`` ids with little padding.

    Expects doc_id, start and length and keeps further columns.  Pieces of equal length are interchangeable: they are
    ranked (by partition, then doc_id and start) and a rank is looked up among the places that the patterns have for
    the length.  Repeated rows get a place each; an empty table gives no rows.

    The histogram has ``length`` entries and the patterns number a small multiple of it at any input size, so both
    are small on the driver.  Ranks inside a length that many pieces share come from counts by partition.
    """
    spark = pieces.sparkSession
    chunked = cut(pieces.withColumn("key_", id_key()).drop("doc_id").withColumn("chunk", F.spark_partition_id()))
    counts = chunked.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = cut(counts.selectExpr("*", "sum(n) OVER (PARTITION BY length ORDER BY chunk) - n AS before"))
    histogram = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = slot_table(shortest_pack_first(histogram, length))
    ranked = (
        chunked.selectExpr("*", "row_number() OVER (PARTITION BY length, chunk ORDER BY key_, start) - 1 AS place")
        .join(before.drop("n"), ["length", "chunk"])
        .withColumn("rank", F.col("before") + F.col("place"))
        .drop("before", "place", "chunk")
    )

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for s in np.unique(size).tolist():
                rows, places = np.flatnonzero(size == s), slots[s]
                at = np.searchsorted(places[:, 0], rank[rows], side="right") - 1
                sequence[rows] = places[at, 1] + rank[rows] - places[at, 0]
                offset[rows] = places[at, 2]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sequence), pa.array(offset)],
                names=[*batch.schema.names, "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    placed = ranked.mapInArrow(put, f"{schema}, sequence_id long, offset long").drop("rank")
    return placed.withColumn("doc_id", original_id("key_")).drop("key_")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence in order, without padding; needs pieces that kept their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    pieces = token_pieces(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_ids=False)
    return pack(pieces, 1024).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
