"""Suffix-array dedup: remove passages of a number of bytes that also start earlier in the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .common import as_bytes, carried, documents, id_key, mix, original_id, uncarried
from .suffix_sort import deep_shallow_order

GRAM = 24  # bytes of an anchor
SEGMENT = 1 << 20  # positions looked at together; a place among them takes the low 20 bits of a key
PLACE = np.uint64(SEGMENT - 1)
ODD = np.uint64(0x9E3779B97F4A7C15)
SAMPLED = np.uint64(2**64 // 32)  # strings of smaller hash are counted wherever they stand
HOT = 2000  # an anchor in so many places is dealt out by finer keys
FINE = 4  # windows that a finer key stands for
HELD = 300_000  # pieces remembered by a task to meet their copies


def anchors(text: bytes, width: int) -> tuple[np.ndarray, ...]:
    """(hash, first, last, place) of each run of windows that share an anchor, then (hash, place) of sampled strings.

    A window of ``width`` bytes has as anchor its leftmost 24-byte string of smallest hash, so equal windows have
    equal anchors at equal places.  Runs cover all windows in order.  Sampled are the 24-byte strings whose hash is
    below a bound, whatever stands around them, so a repeated window repeats all its sampled strings.
    """
    n = len(text) - width + 1
    if n < 1:
        none, no = np.empty(0, np.int64), np.empty(0, np.uint64)
        return no, none, none, none, no, none
    found = []
    step = SEGMENT - width
    for begin in range(0, n, step):
        end = min(n, begin + step)  # window starts begin..end-1
        data = np.frombuffer(text, np.uint8, end - begin + width - 1, begin)
        h = (data.astype(np.uint64) + np.uint64(1)) * ODD
        h = h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:]  # 2
        h = h[:-2] * np.uint64(0xD6E8FEB86659FD93) + (h[2:] ^ (h[2:] >> np.uint64(29)))  # 4
        h = h[:-4] * np.uint64(0xA0761D6478BD642F) + (h[4:] ^ (h[4:] >> np.uint64(31)))  # 8
        h = h[:-16] * np.uint64(0xE7037ED1A0B428DB) + h[8:-8] * np.uint64(0x8EBC6AF09C88C6E3) + h[16:]  # 24
        h = mix(h)
        key = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
        span, size = width - GRAM + 1, 1
        while 2 * size <= span:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        if size < span:
            key = np.minimum(key[: len(key) - (span - size)], key[span - size :])
        owner = (key & PLACE).astype(np.int64)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        last = np.r_[first[1:], len(owner)] - 1
        sampled = np.flatnonzero(h < SAMPLED)
        found.append((h[owner[first]], begin + first, begin + last, begin + owner[first], h[sampled], begin + sampled))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _anchor_rows(texts: DataFrame, width: int) -> DataFrame:
    """(hash, key_, n): each distinct anchor or sampled string of a text and its number of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, keys, counts = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                if len(text) < width:
                    continue
                owners, _, _, _, sampled, _ = anchors(text, width)
                h, n = np.unique(np.concatenate([owners[owners >= SAMPLED], sampled]), return_counts=True)
                hashes.append(h.view(np.int64))
                counts.append(n.astype(np.int32))
                keys.append(np.full(len(h), key, np.int64))
            if hashes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in (hashes, keys, counts)], names=["hash", "key_", "n"]
                )

    return texts.select("key_", "text").mapInArrow(run, "hash long, key_ long, n int")


def text_sum(text: bytes) -> int:
    """Tells the texts of one doc_id apart."""
    return xxhash.xxh3_64_intdigest(text) - 2**63


class Pieces:
    """Pieces of texts with repeated anchors; of equal pieces in a task only the earliest is passed on.

    A piece holds the bytes of a run of windows.  The later copies are settled: all their windows start earlier too.
    """

    def __init__(self, width: int):
        self.width = width
        self.held: dict[bytes, tuple] = {}
        self.rows: list[tuple] = []
        self.settled: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.n_settled = 0

    def settle(self, place: tuple[int, int, int], length: int) -> None:
        key, start, sum_ = place
        self.settled.setdefault((key, sum_), []).append((start, start + length))
        self.n_settled += 1

    def settled_rows(self) -> list[tuple]:
        """Settled ranges, joined inside a text; they need no company and are dealt out by text."""
        out = []
        for (key, sum_), spans in self.settled.items():
            spans.sort()
            lo, hi = spans[0]
            for a, b in [*spans[1:], (2**62, 2**62)]:
                if a > hi:
                    out.append((key ^ sum_, key, lo, sum_, hi - lo, b""))
                    lo = a
                hi = max(hi, b)
        self.settled, self.n_settled = {}, 0
        return out

    def add(self, held: dict, data: bytes, bucket: int, anchor: int, place: tuple[int, int, int]) -> None:
        """``place``: document, start and text hash, in this order the order of the corpus."""
        old = held.get(data)
        if old is None:
            held[data] = (bucket, anchor, place)
        elif place[:2] > old[2][:2]:
            self.settle(place, len(data))
        elif place[:2] < old[2][:2]:
            self.settle(old[2], len(data))
            held[data] = (bucket, anchor, place)
        elif place != old[2]:  # another text of the same document and start: neither is earlier
            self.rows.append((bucket, *place, len(data), data))

    def add_text(self, key: int, sum_: int, text: bytes, repeated: np.ndarray, hot: np.ndarray) -> None:
        h, first, last, owner, sampled, place = anchors(text, self.width)
        h, sampled = h.view(np.int64), sampled.view(np.int64)
        at = np.minimum(np.searchsorted(repeated, h), len(repeated) - 1)
        found = repeated[at] == h
        # a repeated window holds no sampled string that stands alone: it starts after the last and ends before the next
        alone = place[repeated[np.minimum(np.searchsorted(repeated, sampled), len(repeated) - 1)] != sampled]
        alone = np.unique(np.r_[-1, alone, len(text) + self.width])
        following = np.searchsorted(alone, owner)
        first = np.maximum(first, alone[following - 1] + 1)
        last = np.minimum(last, alone[following] - (self.width - GRAM) - 1)
        chosen = np.flatnonzero(found & (first <= last))
        for bucket, a, b, p, many in zip(
            h[chosen].tolist(),
            first[chosen].tolist(),
            last[chosen].tolist(),
            owner[chosen].tolist(),
            hot[at[chosen]].tolist(),
            strict=True,
        ):
            self.add(self.held, text[a : b + self.width], bucket, p - a if many else -1, (key, a, sum_))

    def flush(self) -> list[tuple]:
        """(bucket, key_, start, sum_, length, data); rows without data are settled."""
        fine: dict[bytes, tuple] = {}
        for data, (bucket, anchor, place) in self.held.items():
            if anchor < 0:
                self.rows.append((bucket, *place, len(data), data))
                continue
            # windows by their distance to the anchor, in blocks whose common bytes are the finer key
            windows = len(data) - self.width + 1
            a = 0
            while a < windows:
                block = (anchor - a) // FINE
                b = min(windows - 1, anchor - block * FINE)
                core = anchor - block * FINE
                common = data[core : core - FINE + 1 + self.width]
                key = xxhash.xxh3_64_intdigest(common, block) - 2**63
                self.add(fine, data[a : b + self.width], key, 0, (place[0], place[1] + a, place[2]))
                a = b + 1
        for data, (bucket, _, place) in fine.items():
            self.rows.append((bucket, *place, len(data), data))
        out, self.rows, self.held = self.rows + self.settled_rows(), [], {}
        return out


PIECE = "bucket long, key_ long, start long, sum_ long, length int, data binary"


def _pieces(texts: DataFrame, width: int) -> DataFrame:
    """Pieces (``PIECE``) of the (key_, text, repeated and carried) rows."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    names = ["bucket", "key_", "start", "sum_", "length", "data"]

    def rows(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(found), 50_000):
            columns = zip(*found[at : at + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(width)
        for batch in batches:
            for i, text in enumerate(as_bytes(batch.column(1))):
                anchors_of = batch.column(2)[i]
                repeated = anchors_of.values.field(0).to_numpy(zero_copy_only=False)
                hot = anchors_of.values.field(1).to_numpy(zero_copy_only=False)
                by = np.argsort(repeated)
                pieces.add_text(batch.column(0)[i].as_py(), text_sum(text), text, repeated[by], hot[by])
                if len(pieces.held) + len(pieces.rows) > HELD:
                    yield from rows(pieces.flush())
                elif pieces.n_settled > HELD:
                    yield from rows(pieces.settled_rows())
        yield from rows(pieces.flush())

    carried_ = [c for c in texts.columns if c == "carry_"]  # read here only so that both joins share one shuffle
    return texts.select("key_", "text", "repeated", *carried_).mapInArrow(run, PIECE)


def later_windows(
    data: list[bytes], key: np.ndarray, start: np.ndarray, bucket: np.ndarray, width: int
) -> list[tuple[int, int, int]]:
    """(piece, first, last): runs of windows of the pieces that also start earlier in another place among them."""
    out: list[tuple[int, int, int]] = []
    # of equal pieces only the earliest need be looked at; all windows of the later ones start earlier in it
    earliest: dict[bytes, int] = {}
    order = np.lexsort((start, key)).tolist()
    distinct = np.zeros(len(data), bool)
    for i in order:
        at = earliest.setdefault(data[i], i)
        if at == i or (key[at], start[at]) == (key[i], start[i]):
            distinct[i] = True
        else:
            out.append((i, 0, len(data[i]) - width))
    rest = np.flatnonzero(distinct)
    _, where, many = np.unique(bucket[rest], return_inverse=True, return_counts=True)
    live = rest[many[where] > 1]  # pieces whose anchor stands alone here hold no repeated window
    if not len(live):
        return out
    data, key, start, number = [data[i] for i in live.tolist()], key[live], start[live], live
    length = np.fromiter(map(len, data), np.int64, len(data))
    text = np.frombuffer(b"".join(data) + bytes(256), np.uint8)
    begin = np.cumsum(length) - length
    # every window of those pieces as a suffix cut at the width
    windows = length - width + 1
    piece = np.repeat(np.arange(len(data)), windows)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    order, rank = deep_shallow_order(text, begin[piece] + offset, width)
    at = start[piece] + offset
    # the earliest place of each group of equal windows
    group = np.empty(len(order), np.int64)
    group[order] = rank
    by = np.lexsort((at, key[piece], group))
    head = np.r_[True, group[by[1:]] != group[by[:-1]]]
    lead = by[np.flatnonzero(head)[np.cumsum(head) - 1]]
    later = np.zeros(len(order), bool)
    later[by] = (key[piece[by]] != key[piece[lead]]) | (at[by] != at[lead])
    # runs of later windows inside a piece
    edge = np.flatnonzero(np.diff(np.r_[0, later.astype(np.int8), 0]))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        while a < b:
            p = int(piece[a])
            end = min(b, a + int(length[p] - width + 1 - offset[a]))
            out.append((int(number[p]), int(offset[a]), int(offset[end - 1])))
            a = end
    return out


def _removed(pieces: DataFrame, width: int, most: int = 4 << 20) -> DataFrame:
    """(key_, sum_, lo, hi): removed byte ranges, several of which may touch or overlap."""
    dealt = pieces.repartition("bucket").sortWithinPartitions("bucket")

    def settle(columns: list[np.ndarray], data: list[bytes]) -> pa.RecordBatch:
        bucket, key, start, sum_, _ = columns
        spans = later_windows(data, key, start, bucket, width)
        p = np.array([s[0] for s in spans], np.int64)
        lo = start[p] + np.array([s[1] for s in spans], np.int64)
        hi = start[p] + np.array([s[2] + width for s in spans], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (key[p], sum_[p], lo, hi)], names=NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[list[np.ndarray], list[bytes]]] = []
        held = 0
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            data = batch.column(5).to_pylist()
            settled = columns[4] > 0
            settled[[i for i, d in enumerate(data) if d]] = False
            if settled.any():
                _, key, start, sum_, length = (c[settled] for c in columns)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (key, sum_, start, start + length)], names=NAMES
                )
            rest = np.flatnonzero(~settled)
            if not len(rest):
                continue
            data = [data[i] for i in rest.tolist()]
            columns = [c[rest] for c in columns]
            held += sum(map(len, data))
            if waiting and held > most:  # buckets are in order: all but the last one held are complete
                last = columns[0][-1]
                merged = [np.concatenate(c) for c in zip(*(w[0] for w in waiting), columns, strict=True)]
                every = [d for w in waiting for d in w[1]] + data
                keep = np.flatnonzero(merged[0] == last)
                cut_at = int(keep[0])
                if cut_at:
                    yield settle([c[:cut_at] for c in merged], every[:cut_at])
                waiting = [([c[cut_at:] for c in merged], every[cut_at:])]
                held = sum(map(len, every[cut_at:]))
            else:
                waiting.append((columns, data))
        if waiting:
            yield settle([np.concatenate(c) for c in zip(*(w[0] for w in waiting), strict=True)], [d for w in waiting for d in w[1]])

    return dealt.mapInArrow(run, "key_ long, sum_ long, lo long, hi long")


NAMES = ["key_", "sum_", "lo", "hi"]


def whole_characters(text: bytes, lo: int, hi: int) -> tuple[int, int]:
    """The part of a byte range that holds whole characters."""
    while lo < hi and text[lo] & 0xC0 == 0x80:
        lo += 1
    while hi > lo and hi < len(text) and text[hi] & 0xC0 == 0x80:
        hi -= 1
    return lo, hi


def repeated_passages(
    docs: DataFrame, width: int = 100, characters: bool = False, carry: list[str] | None = None
) -> DataFrame:
    """(doc_id, kept, spans, n_bytes and the columns to carry along), one row per input row.

    ``spans`` are the maximal removed (lo, hi) byte ranges.

    A text counts as its UTF-8 bytes (null: none).  A byte is removed when a string of ``width`` bytes that covers it
    also starts earlier: in a smaller doc_id, or in the same document at an earlier start.  Overlapping strings count,
    strings never cross documents, and all are judged on the input.  ``kept`` holds the remaining bytes; cut inside a
    character they need not be valid UTF-8, unless ``characters`` asks that only whole characters go.

    Texts shorter than ``width`` lose nothing.  Rows that share a doc_id are texts of one document: their strings are
    compared by start alone, so equal rows keep the same bytes.  Null ids stand last as one document.  Other columns
    are ignored and an empty table gives no rows.

    Equal strings have equal anchors (the 24-byte string of smallest hash in each window), so only windows whose anchor
    and sampled strings occur twice or more are looked at: they travel as short pieces to the anchor's task, where
    they are put in suffix order.  Copies of a piece inside a task are settled before the shuffle, and an anchor with
    very many places is dealt out by the bytes its windows share, so no key gathers all of a passage's contexts.
    """
    carry = carry or []
    # both joins below ask for the same columns by the same key, so the texts are shuffled once
    texts = docs.select(
        id_key().alias("key_"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *([carried(docs, carry)] if carry else []),
    )
    found = _anchor_rows(texts, width)
    repeated = cut(
        found.groupBy("hash")
        .agg(F.sum("n").alias("n"))
        .filter("n > 1")
        .select("hash", (F.col("n") >= HOT).alias("hot"))
    )
    lists = (
        found.select("hash", "key_")
        .join(repeated, "hash")
        .groupBy("key_")
        .agg(F.collect_set(F.struct("hash", "hot")).alias("repeated"))
    )
    removed = _removed(_pieces(texts.join(lists, "key_"), width), width)
    spans = removed.groupBy("key_").agg(F.collect_list(F.struct("sum_", "lo", "hi")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, merged, sizes = [], [], []
            for text, found_ in zip(as_bytes(batch.column(1)), batch.column(2), strict=True):
                sizes.append(len(text))
                if not found_.is_valid:
                    kept.append(text)
                    merged.append([])
                    continue
                sums, lo, hi = (found_.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                own = sums == text_sum(text)  # a doc_id may stand for several texts
                lo, hi = lo[own], hi[own]
                if not len(lo):
                    kept.append(text)
                    merged.append([])
                    continue
                by = np.argsort(lo, kind="stable")
                lo, hi = lo[by], np.maximum.accumulate(hi[by])
                first = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
                lo, hi = lo[first], hi[np.r_[first[1:], len(hi)] - 1]
                spans = list(zip(lo.tolist(), hi.tolist(), strict=True))
                if characters:
                    spans = [(a, b) for a, b in (whole_characters(text, *span) for span in spans) if a < b]
                ends, starts = [0, *(b for _, b in spans)], [*(a for a, _ in spans), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(ends, starts, strict=True)))
                merged.append([{"lo": a, "hi": b} for a, b in spans])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(kept, pa.binary()),
                    pa.array(merged, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))),
                    pa.array(sizes, pa.int64()),
                    *batch.columns[3:],
                ],
                names=["key_", "kept", "spans", "n_bytes", "carry_"][: batch.num_columns + 1],
            )

    schema = "key_ long, kept binary, spans array<struct<lo:long,hi:long>>, n_bytes long"
    if carry:
        schema += f", carry_ {texts.schema['carry_'].dataType.simpleString()}"
    out = texts.join(spans, "key_", "left").select("key_", "text", "spans", *texts.columns[2:]).mapInArrow(run, schema)
    return out.select(original_id("key_").alias("doc_id"), "kept", "spans", "n_bytes", *uncarried(carry))


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = repeated_passages(documents(spark, folder), 100)
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
