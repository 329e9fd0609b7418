"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null document id sorts after every other id and counts as one document.
NULL_ID = 2**63 - 1
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet")


def id_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def original_id(key: str) -> Column:
    return F.when(F.col(key) != NULL_ID, F.col(key))


def carried(docs: DataFrame, columns: list[str]) -> Column:
    """Further columns of a row as one struct, so that no name clashes on the way."""
    return F.struct(F.lit(0).alias("none_"), *[F.col(c) for c in columns]).alias("carry_")


def uncarried(columns: list[str]) -> list[Column]:
    return [F.col("carry_").getField(c).alias(c) for c in columns]


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null counts as empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return [v or "" for v in column.to_pylist()]


def runs(texts: list[bytes], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``most`` bytes together; a longer text stands alone."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20)
    values = random.integers(1, 2**63, 256, np.uint64)
    values[65:91] = values[97:123]  # A-Z count as a-z
    space = np.zeros(256, bool)
    space[list(ASCII_SPACE)] = True
    return values, space


BYTE_VALUE, IS_SPACE = _tables()
FACTOR, ODD = 0xD1342543DE82EF95, np.uint64(0x9E3779B97F4A7C15)
INVERSE = pow(FACTOR, -1, 2**64)


class WordHashes:
    """64-bit hashes of the words of texts, A-Z lower-cased; words are runs without ASCII white space.

    A word's hash is a polynomial in its bytes, taken as the difference of two running sums over the whole run of
    texts, so no word becomes an object of its own.
    """

    def __init__(self):
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, factor in (("powers", FACTOR), ("inverse", INVERSE)):
                steps = np.full(n, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words in order, words of each text)."""
        data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        if not len(data):
            return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
        self._grow(len(data))
        space = IS_SPACE[data]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        start, end = edge[::2], edge[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * self.powers[: len(data)], out=sums[1:])
        h = mix((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * ODD)
        closes = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        return h, np.diff(np.searchsorted(start, closes), prepend=0)
