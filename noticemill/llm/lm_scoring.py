"""LM scoring: quantised n-gram counts in a log-frequency Bloom filter, smoothed from membership probes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .common import WordHashes, as_bytes, documents, mix, runs

ODD = np.uint64(0x9E3779B97F4A7C15)
LEVEL = np.uint64(0xC2B2AE3D27D4EB4F)
END, BEGIN = np.uint64(0x51A3F0C2D4E59B17), np.uint64(0x2E7B91D60F43AC85)
BASE = 1.5  # a count's level is 1 + floor(log(count) / log(BASE))
PROBES = 5  # bits of an entry, all in one 64-bit word
BITS = 12  # bits of filter for each entry
RATIOS = 96  # bins of log ratios, bin 0: no evidence
LEVELS = 256


def level_counts() -> np.ndarray:
    """Mean of the whole numbers that share a level; level 0 is no count."""
    edges = BASE ** np.arange(LEVELS + 1)
    low, high = np.ceil(edges[:-1] - 1e-9), np.ceil(edges[1:] - 1e-9) - 1
    return np.r_[0.0, np.where(high >= low, (low + high) / 2, edges[:-1])[: LEVELS - 1]]


def level_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _entry(h: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Place and bit mask of an n-gram's entry for a level."""
    key = mix(h + np.asarray(level).astype(np.uint64) * LEVEL)
    mask = np.zeros(len(key), np.uint64)
    for i in range(PROBES):
        mask |= np.uint64(1) << ((key >> np.uint64(6 * i)) & np.uint64(63))
    return key >> np.uint64(32), mask


def filter_slice(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words of the filter for one bucket: an entry for each n-gram and each level up to its own."""
    levels = level_of(counts)
    which = np.repeat(np.arange(len(h)), levels)
    level = np.arange(len(which)) - np.repeat(np.cumsum(levels) - levels, levels) + 1
    place, mask = _entry(h[which], level)
    words = np.zeros(max(1, -(-len(which) * BITS // 64)), np.uint64)
    at = (place % np.uint64(len(words))).astype(np.int64)
    order = np.argsort(at, kind="stable")
    at, mask = at[order], mask[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    words[at[first]] = np.bitwise_or.reduceat(mask, first)
    return words


class Filter:
    """The filter's slices of some buckets; the others hold nothing."""

    def __init__(self, words: bytes | bytearray, sizes: bytes):
        self.words, self.sizes = np.frombuffer(words, np.uint64), np.frombuffer(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The highest level up to which all entries are found, by probing level after level."""
        out = np.zeros(len(h), np.uint8)
        bucket = bucket_of(h, len(self.sizes))
        active = np.flatnonzero(self.sizes[bucket] > 0)
        start, size, h = self.starts[bucket[active]], self.sizes[bucket[active]].astype(np.uint64), h[active]
        for level in range(1, LEVELS):
            if not len(active):
                break
            place, mask = _entry(h, level)
            hit = (self.words[start + (place % size).astype(np.int64)] & mask) == mask
            active, start, size, h = active[hit], start[hit], size[hit], h[hit]
            out[active] = level
        return out


def tokens(texts: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, their contexts, tokens of each text): A-Z lower-cased words and an end for each text."""
    words, sizes = hashes(texts)
    ends = np.cumsum(sizes + 1) - 1
    h = np.empty(len(words) + len(sizes), np.uint64)
    is_word = np.ones(len(h), bool)
    is_word[ends] = False
    h[is_word], h[ends] = words, END
    before = np.r_[BEGIN, h[:-1]]
    before[ends[:-1] + 1] = BEGIN
    return h, before, sizes + 1


def pairs(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(before * ODD + h)


def is_held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1


def ngram_counts(texts: DataFrame, buckets: int, most: int = 4_000_000) -> DataFrame:
    """(bucket, size, hash, n) of the tokens (size 1) and of pairs of neighbouring tokens (size 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def counted() -> Iterator[pa.RecordBatch]:
            for size, parts in enumerate(zip(*held, strict=True), 1):
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                for at in range(0, len(h), 200_000):
                    these = h[at : at + 200_000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(bucket_of(these, buckets)),
                            pa.array(np.full(len(these), size, np.int32)),
                            pa.array(these.view(np.int64)),
                            pa.array(n[at : at + 200_000].astype(np.int64)),
                        ],
                        names=["bucket", "size", "hash", "n"],
                    )
            held.clear()

        waiting = 0
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for lo, hi in runs(texts, 2 << 20):
                h, before, _ = tokens(texts[lo:hi], hashes)
                held.append((h, pairs(before, h)))
                waiting += len(h)
                if waiting >= most:
                    yield from counted()
                    waiting = 0
        yield from counted()

    rows = texts.select("text").mapInArrow(run, "bucket long, size int, hash long, n long")
    # one shuffle: groups lie inside buckets
    return rows.repartition("bucket").groupBy("bucket", "size", "hash").agg(F.sum("n").alias("n"))


def _slices(counts: DataFrame) -> DataFrame:
    """(bucket, words, hash, n): the filter's slice of each bucket, and by rows without ``words`` each token's count.

    Expects all rows of a bucket in one partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            parts.append([batch.column(i).to_numpy() for i in (0, 2, 3)])
            single = batch.filter(pa.array(batch.column(1).to_numpy() == 1))
            yield pa.RecordBatch.from_arrays(
                [single.column(0), pa.nulls(len(single), pa.binary()), single.column(2), single.column(3)], names=NAMES
            )
        if not parts:
            return
        bucket, h, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(bucket, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
        for a, b in zip(first, np.r_[first[1:], len(order)], strict=True):
            these = order[a:b]
            words = filter_slice(h[these].view(np.uint64), n[these])
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket[these[0]]]), pa.array([words.tobytes()], pa.binary()), none, none], names=NAMES
            )

    return counts.select("bucket", "size", "hash", "n").mapInArrow(run, "bucket long, words binary, hash long, n long")


NAMES = ["bucket", "words", "hash", "n"]


class Found:
    """Levels of a run of texts: of each token, of its context and of both together."""

    def __init__(self, h: np.ndarray, before: np.ndarray, sizes: np.ndarray):
        self.h, self.before, self.sizes = h, before, sizes
        self.words, self.at = np.unique(np.r_[h, BEGIN], return_inverse=True)
        self.context_at = np.searchsorted(self.words, before)
        self.word_level = np.zeros(len(self.words), np.uint8)
        self.pair_level = np.zeros(len(h), np.uint8)

    def probe(self, filter_: Filter) -> None:
        # a context's count is the count of its token; texts begin as often as they end
        asked = np.where(self.words == BEGIN, END, self.words)
        self.word_level = np.maximum(self.word_level, filter_.levels(asked))
        self.pair_level = np.maximum(self.pair_level, filter_.levels(pairs(self.before, self.h)))

    def state(self) -> bytes:
        return self.word_level[self.at[:-1]].tobytes() + self.word_level[self.context_at].tobytes() + self.pair_level.tobytes()


def _probed(texts: DataFrame, filters: list, then: Callable, schema: str, keep: list[str]) -> DataFrame:
    """``then(batch, lo, hi, found)`` for runs of texts after probing every filter.

    With one filter this is one pass.  With more, each pass adds what its part of the filter knows to a column of
    levels and is written before the next, as chained steps would run in one task and hold all their parts.
    """

    def step(filter_, last: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, probe = WordHashes(), Filter(*filter_.value)
            for batch in batches:
                data = as_bytes(batch.column(0))
                states = batch.column(1).to_pylist()
                grown = []
                for lo, hi in runs(data, 2 << 20):
                    found = Found(*tokens(data[lo:hi], hashes))
                    found.probe(probe)
                    size = len(found.h)
                    if any(states[lo:hi]):
                        old = [np.frombuffer(s, np.uint8).reshape(3, -1) for s in states[lo:hi]]
                        word, context, pair = np.concatenate(old, axis=1)
                        np.maximum.at(found.word_level, found.at[:-1], word)
                        np.maximum.at(found.word_level, found.context_at, context)
                        found.pair_level = np.maximum(found.pair_level, pair)
                    if last:
                        yield then(batch, lo, hi, found)
                    else:
                        whole = np.frombuffer(found.state(), np.uint8).reshape(3, size)
                        ends = np.cumsum(found.sizes)
                        grown += [whole[:, e - s : e].tobytes() for e, s in zip(ends, found.sizes, strict=True)]
                if not last:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), pa.array(grown, pa.binary()), *batch.columns[2:]], names=batch.schema.names
                    )

        return run

    df = texts.select("text", F.lit(None).cast("binary").alias("state"), *keep)
    between = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    for i, filter_ in enumerate(filters):
        last = i == len(filters) - 1
        df = df.mapInArrow(step(filter_, last), schema if last else between)
        if not last:
            df = cut(df)
    return df


def _mixture(found: Found, means: np.ndarray, total: float, kinds: float, leave_out: int) -> tuple:
    """(unigram probability, ratio of the pair estimate to it, level of the context) of each token."""
    word = means[found.word_level][found.at[:-1]]
    context_level = found.word_level[found.context_at]
    context = means[context_level] - leave_out
    pair = np.maximum(means[found.pair_level] - leave_out, 0)
    single = (word + 0.5) / (total + 0.5 * (kinds + 1))
    ratio = np.where(context > 0, np.minimum(pair / np.maximum(context, 1), 1.0) / single, 0.0)
    return single, ratio, context_level


def fit_weights(histogram: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weight of the pair estimate by context level, by expectation maximisation on (level, log ratio) counts."""
    ratio = np.r_[0.0, 2.0 ** ((np.arange(1, RATIOS) - RATIOS // 3) / 2)]
    weight = np.full(len(histogram), 0.3)
    seen = np.maximum(histogram.sum(axis=1), 1)
    for _ in range(rounds):
        share = weight[:, None] * ratio / (weight[:, None] * ratio + 1 - weight[:, None])
        weight = np.clip((histogram * share).sum(axis=1) / seen, 1e-4, 0.999)
    return weight


def ratio_bins(ratio: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        at = np.floor(2 * np.log2(ratio) + 0.5) + RATIOS // 3
    return np.where(ratio > 0, np.clip(at, 1, RATIOS - 1), 0).astype(np.int64)


def lm_scores(
    docs: DataFrame, held_out: Column, filter_bytes: int = 256 << 20, frequent_words: int = 1 << 19
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    Tokens are the A-Z lower-cased runs without ASCII white space and one end for each text; null and empty texts are
    their end alone.  Rows for which ``held_out`` is not true are learned from.  ``base_score`` is the exact unigram
    score with 0.5 added to every count; ``n_known`` counts tokens seen in training.  ``score`` is the log10
    probability of the text under an interpolation of token pairs with single tokens.  Repeated rows are learned from
    and scored each; without training rows the counts are zero; an empty table gives no rows; other columns are
    ignored.

    All counts cover all training rows.  The filter holds an entry for each n-gram and each level of its logarithmic
    count up to its own; a count is read back by probing level after level, and missing n-grams are taken for seen at
    a small known rate.  Weights by context level are fitted on one pass over all training rows that leaves each token
    out of its own counts.  The filter grows with the corpus and is broadcast in parts of at most ``filter_bytes``,
    each part with a pass of its own.  The exact counts of the ``frequent_words`` commonest tokens are broadcast;
    the other tokens of a text meet their counts in a join.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
    )
    training = texts.filter(~F.col("held_out"))
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    learned = cut(_slices(ngram_counts(training, buckets)))
    slices = learned.filter("words IS NOT NULL").select("bucket", "words")
    words = learned.filter("words IS NULL").select("hash", "n")
    total, kinds = (int(x or 0) for x in words.agg(F.sum("n"), F.count("*")).first())
    scale = total + 0.5 * (kinds + 1)

    sizes = {r["bucket"]: r["size"] for r in slices.select("bucket", F.length("words").alias("size")).collect()}
    parts: list[list[int]] = [[]]
    for bucket, size in sorted(sizes.items()):
        if parts[-1] and sum(sizes[b] for b in parts[-1]) + size > filter_bytes:
            parts.append([])
        parts[-1].append(bucket)
    filters = []
    for part in parts:
        length = np.zeros(buckets, np.int64)
        out = bytearray()
        for r in slices.filter(F.col("bucket").isin(part)).orderBy("bucket").toLocalIterator():
            length[r["bucket"]] = len(r["words"]) // 8
            out += r["words"]
        filters.append(context.broadcast((out, length.tobytes())))
        del out
    means = level_counts()

    def tally(batch: pa.RecordBatch, lo: int, hi: int, found: Found) -> pa.RecordBatch:
        _, ratio, level = _mixture(found, means, total, kinds, 1)
        cell, n = np.unique(level.astype(np.int64) * RATIOS + ratio_bins(ratio), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])

    cells = _probed(training, filters, tally, "cell long, n long", []).groupBy("cell").agg(F.sum("n").alias("n"))
    histogram = np.zeros(LEVELS * RATIOS)
    for r in cells.collect():  # at most LEVELS * RATIOS rows
        histogram[r["cell"]] = r["n"]
    weight = fit_weights(histogram.reshape(LEVELS, RATIOS))

    # the commonest words: all above a bound that leaves at most frequent_words of them
    bins = words.groupBy(F.floor(F.log2("n") * 8).alias("bin")).agg(F.count("*").alias("n")).collect()
    above, least = 0, math.inf
    for r in sorted(bins, reverse=True):
        above += r["n"]
        if above > frequent_words:
            break
        least = r["bin"]
    is_frequent = F.floor(F.log2("n") * 8) >= least if least < math.inf else F.lit(False)
    common = words.filter(is_frequent).toPandas().sort_values("hash")
    table = context.broadcast((common["hash"].to_numpy(np.int64), common["n"].to_numpy(np.int64)))

    def finish(batch: pa.RecordBatch, lo: int, hi: int, found: Found) -> pa.RecordBatch:
        single, ratio, level = _mixture(found, means, total, kinds, 0)
        w = weight[level]
        first = np.cumsum(found.sizes) - found.sizes
        score = np.add.reduceat(np.log10(single * (1 - w + w * ratio)), first)
        hash_, n = table.value
        own = found.words.view(np.int64)
        at = np.minimum(np.searchsorted(hash_, own), max(len(hash_) - 1, 0))
        known = hash_[at] == own if len(hash_) else np.zeros(len(own), bool)
        value = np.zeros(len(own))
        if len(hash_):
            value = np.where(known, np.log10((n[at] + 0.5) / scale), 0.0)
        of_token = found.at[:-1]
        base = np.add.reduceat(value[of_token], first)
        is_known = np.add.reduceat(known[of_token].astype(np.int64), first)
        rest, ends = [], np.cumsum(found.sizes)
        for a, b in zip(first.tolist(), ends.tolist(), strict=True):
            rare = found.h[a:b][~known[of_token[a:b]]].view(np.int64)
            rest.append([{"hash": h, "k": k} for h, k in zip(*(x.tolist() for x in np.unique(rare, return_counts=True)), strict=True)])
        return pa.RecordBatch.from_arrays(
            [
                *(batch.column(i).slice(lo, hi - lo) for i in (2, 3)),
                pa.array(found.sizes),
                pa.array(is_known),
                pa.array(base),
                pa.array(score),
                pa.array(rest, pa.list_(pa.struct([("hash", pa.int64()), ("k", pa.int64())]))),
            ],
            names=["doc_id", "held_out", "n_tokens", "known", "base", "score", "rare"],
        )

    schema = "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, "
    scored = _probed(texts, filters, finish, schema + "rare array<struct<hash:long,k:long>>", ["doc_id", "held_out"])
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.inline("rare"))
    rest = (
        rare.join(words, "hash", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("k") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(scale))).alias("more"),
            F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("more_known"),
        )
    )
    return scored.join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )


def op4_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scores(documents(spark, folder), is_held_out())
