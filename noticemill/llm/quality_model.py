"""Quality classifier: a generalised additive model with pairwise interactions on text features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, as_bytes, documents, id_key, original_id
from .quality_rules import SPACE, SYMBOLS, measure

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
CODE = b"{}[]()=;_/\\@~^"
LOOSE = re.compile(rb"[A-Za-z0-9\x80-\xff]")

FEATURES = [
    "log_words",
    "word_length",
    "symbols",
    "upper",
    "digits",
    "beyond_ascii",
    "code",
    "exclaims",
    "stops",
    "distinct",
    "most_common",
    "short_words",
    "loose_marks",
    "line_words",
    "dup_lines",
    "closed_lines",
    "repeats",
]


def _share(data: bytes, drop: bytes, of: int) -> float:
    return (len(data) - len(data.translate(None, drop))) / max(of, 1)


def features(data: bytes) -> list[float]:
    """Numbers about one text; all zero where it has no words."""
    t = measure(data)
    n = len(t.words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = Counter(t.words)
    lines = [line.rstrip(SPACE) for line in data.split(b"\n") if line.strip(SPACE)]
    return [
        float(np.log1p(n)),
        t.word_chars / n,
        t.n_symbols / n,
        _share(data, UPPER, t.word_chars),
        _share(data, DIGITS, t.word_chars),
        (len(data) - len(data.translate(None, bytes(range(0x80, 0x100))))) / len(data),
        _share(data, CODE, n),
        _share(data, b"!?", n),
        _share(data, b".,", n),
        len(counts) / n,
        max(counts.values()) / n,
        sum(1 for size in map(len, t.words) if size < 4) / n,
        sum(k for w, k in counts.items() if not (w.isalnum() or LOOSE.search(w))) / n,
        float(np.log1p(n / len(lines))),
        t.n_dup_lines / len(lines),
        sum(line.endswith((b".", b"!", b"?", b'"', b":")) for line in lines) / len(lines),
        t.n_repeat_words / n,
    ]


@dataclass
class AdditiveModel:
    """Log odds as an intercept, a table of bins for each feature and tables for a few pairs of features."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(edge, x[:, f], side="right") for f, edge in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        odds = np.full(len(x), self.intercept)
        for b, table in zip(bins, self.tables, strict=True):
            odds += table[b]
        for i, j, table in self.pairs:
            odds += table[bins[i], bins[j]]
        return 1 / (1 + np.exp(-odds))


def _best_cut(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """Gain and place of the best cut of a run of bins; place 0: none."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain[(hl < least) | (hr < least)] = 0
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1 if gain[at] > 1e-9 else 0


def _shallow_tree(g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
    """Values by bin of a tree of depth two."""
    out = np.zeros(len(g))
    _, first = _best_cut(g, h, least)
    for lo, hi in ((0, first), (first, len(g))) if first else ((0, len(g)),):
        _, second = _best_cut(g[lo:hi], h[lo:hi], least)
        for a, b in ((lo, lo + second), (lo + second, hi)) if second else ((lo, hi),):
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best pair of crossing cuts of a two-way table."""
    pad = lambda t: np.pad(t.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    gc, hc = pad(g), pad(h)
    gain = np.zeros((g.shape[0] + 1, g.shape[1] + 1))
    for part in range(4):
        up, left = part & 1, part >> 1
        take = lambda c: (
            (c if not left else c[:, -1:] - c)
            if not up
            else ((c[-1:] - c) if not left else c[-1, -1] - c[-1:] - c[:, -1:] + c)
        )
        gain += take(gc) ** 2 / (take(hc) + 1)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros(g.shape)
    for rows in (slice(0, i), slice(i, None)):
        for cols in (slice(0, j), slice(j, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + 1)
    return float(gain[i, j] - g.sum() ** 2 / (h.sum() + 1)), out


def fit_additive(
    x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, rate: float = 0.12, n_pairs: int = 4
) -> AdditiveModel:
    """Boost shallow trees feature by feature in turn, then the pairs that explain most of what is left.

    Without rows the model says one half; a constant feature or a single class leaves the smoothed share of ones.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(y) else np.zeros(0) for c in x.T]
    model = AdditiveModel(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges])
    if not len(y) or y.min() == y.max():
        return model
    at, odds = model.bins(x), np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-odds))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for b, table in zip(at, model.tables, strict=True):
            g, h = slopes()
            step = rate * _shallow_tree(np.bincount(b, g, len(table)), np.bincount(b, h, len(table)), 1.0)
            table += step
            odds += step[b]

    def two_way(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        shape = len(model.tables[i]), len(model.tables[j])
        cell = at[i] * shape[1] + at[j]
        return tuple(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    n = len(at)
    ranked = sorted(((_quadrants(*two_way(i, j))[0], i, j) for i in range(n) for j in range(i)), reverse=True)
    model.pairs = [(i, j, np.zeros((len(model.tables[i]), len(model.tables[j])))) for _, i, j in ranked[:n_pairs]]
    for _ in range(rounds // 3):
        for i, j, table in model.pairs:
            step = rate * _quadrants(*two_way(i, j))[1]
            table += step
            odds += step[at[i], at[j]]
    return model


def fold(key: str = "key_") -> Column:
    """0 for ids that training never sees."""
    return F.crc32(F.coalesce(original_id(key).cast("string"), F.lit(""))) % 5


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> AdditiveModel:
    """A model of ``labels`` (doc_id, quality) learned from the texts of ``docs``.

    At most ``fit_rows`` labelled documents are looked at, those with the smallest hash of their id; rows whose
    crc32(doc_id as text) mod 5 is 0 are never among them.  A null quality is no label; of several labels of one id
    the least counts; null ids are left out.  Feature rows of 17 numbers come to the driver.
    """
    known = (
        labels.select(id_key().alias("key_"), F.col("quality").cast("int").alias("y"))
        .filter(F.col("y").isNotNull() & (F.col("key_") != NULL_ID) & (fold() != 0))
        .groupBy("key_")
        .agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("key_"), "key_")
        .limit(fit_rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(data) for data in as_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    texts = docs.select(id_key().alias("key_"), F.col("text").cast("string").alias("text"))
    labelled = texts.join(F.broadcast(known), "key_").select("text", "y")  # at most fit_rows short rows
    sample = labelled.mapInArrow(run, "x array<double>, y int").limit(fit_rows).toPandas()
    return fit_additive(np.array(sample["x"].tolist(), float).reshape(-1, len(FEATURES)), sample["y"].to_numpy(float))


def _scores(model: AdditiveModel, texts: pa.Array) -> np.ndarray:
    return model.score(np.array([features(data) for data in as_bytes(texts)], float).reshape(-1, len(FEATURES)))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_rows: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted): a score from 0 to 1 for each row, higher for good text.

    See ``fit_quality`` for what is learned from.  Every row is scored by its text alone, in one pass without a
    shuffle.  Null and empty texts are scored as texts without words; without labels every score is one half; repeated
    rows each get a row; null ids are held out; other columns are ignored.
    """
    model = fit_quality(docs, labels, fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(_scores(model, batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), score], names=["key_", "score"])

    texts = docs.select(id_key().alias("key_"), F.col("text").cast("string"))
    return texts.mapInArrow(run, "key_ long, score double").select(
        original_id("key_").alias("doc_id"),
        (fold() == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_rows: int = 20_000) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, with all their columns."""
    model = fit_quality(docs, labels, fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(_scores(model, texts) >= threshold))

    return docs.select("*", F.col("text").cast("string").alias("judged_")).mapInArrow(run, docs.schema)


def op9_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder.rstrip('/')}/labels.parquet")
    return quality_scores(documents(spark, folder), labels)
