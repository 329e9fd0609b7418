"""Quality rules: measured first on a sample, then run as a short-circuit cascade."""

from __future__ import annotations

import re
import time
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, documents, mix

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
NOT_CHARACTERS = SPACE + bytes(range(0x80, 0xC0))  # white space and continuation bytes
WINDOW = 8
ODD = np.uint64(0x9E3779B97F4A7C15)
LETTER = re.compile(rb"[A-Za-z\x80-\xff]")


@dataclass
class Text:
    """A text with what the base counts have found."""

    data: bytes
    words: list[bytes]
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


def repeated_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that occur twice or more in the text."""
    n = len(words)
    if n <= WINDOW:
        return 0
    numbers: dict[bytes, int] = defaultdict(count(1).__next__)
    ids = np.fromiter(map(numbers.__getitem__, words), np.uint64, n)
    h = mix(ids * ODD)
    for width in (1, 2, 4):
        h = mix(h[:-width] * ODD + h[width:])
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    starts = np.flatnonzero(twice)
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    edge[starts + WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


def measure(data: bytes) -> Text:
    words = data.split()  # for bytes: exactly the six ASCII space characters
    lines = [line for line in data.split(b"\n") if line.strip(SPACE)]
    return Text(
        data,
        words,
        len(data.translate(None, NOT_CHARACTERS)),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _mean_length(t: Text) -> bool:
    return not 2 * len(t.words) <= t.word_chars <= 14 * len(t.words)


def _symbol_share(t: Text) -> bool:
    return 10 * t.n_symbols > len(t.words)


def _dup_lines(t: Text) -> bool:
    return 10 * t.n_dup_lines > 3 * sum(bool(line.strip(SPACE)) for line in t.data.split(b"\n"))


def _few_letters(t: Text) -> bool:
    """Fewer than seven in ten words hold a letter (any byte beyond ASCII counts as one)."""
    lettered = sum(1 for w in t.words if w.isalpha() or LETTER.search(w))
    return 10 * lettered < 7 * len(t.words)


def _shouting(t: Text) -> bool:
    upper = len(t.data) - len(t.data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return 2 * upper > t.word_chars


def _one_word(t: Text) -> bool:
    """One word makes up more than a quarter of a text."""
    return 4 * max(Counter(t.words).values(), default=0) > len(t.words)


#: Rules by name; true rejects.  Their order here has no meaning.
RULES: dict[str, Callable[[Text], bool]] = {
    "mean_length": _mean_length,
    "symbol_share": _symbol_share,
    "dup_lines": _dup_lines,
    "few_letters": _few_letters,
    "shouting": _shouting,
    "one_word": _one_word,
}


def base_failed(t: Text) -> bool:
    n = len(t.words)
    return n < 20 or 100 * t.n_repeat_words > 30 * n


def cascade_order(docs: DataFrame, rules: dict[str, Callable[[Text], bool]], sample_rows: int = 2000) -> list[str]:
    """Rule names by falling rejections per second, measured on at most ``sample_rows`` rows.

    Each rule runs on every sampled text that passes the base rule; only counts and seconds come to the driver.  The
    order changes the cost of the cascade and never its verdict.
    """
    names = list(rules)

    def trial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, rejected, tried = [0.0] * len(names), [0] * len(names), 0
        for batch in batches:
            for data in as_bytes(batch.column(0)):
                text = measure(data)
                if base_failed(text):
                    continue
                tried += 1
                for i, name in enumerate(names):
                    began = time.perf_counter()
                    rejected[i] += rules[name](text)
                    seconds[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array(seconds), pa.array(rejected, pa.int64()), pa.array([tried] * len(names))],
            names=["name", "seconds", "rejected", "tried"],
        )

    sample = docs.select(F.col("text").cast("string")).limit(sample_rows)
    found = sample.mapInArrow(trial, "name string, seconds double, rejected long, tried long")
    totals = found.groupBy("name").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("n")).collect()
    worth = {r["name"]: r["n"] / (r["s"] + 1e-6) for r in totals}
    return sorted(names, key=lambda name: (-worth.get(name, 0.0), name))


def quality_rules(
    docs: DataFrame, rules: dict[str, Callable[[Text], bool]] | None = None, sample_rows: int = 2000
) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rejected_by, kept).

    Words are runs of characters other than ASCII white space.  The base rule rejects texts of under 20 words or with
    more than 30 in 100 words inside repeated 8-word windows; the other rules then run in the measured order and stop
    at the first that rejects, named in ``rejected_by`` (``base`` for the base rule, null for a kept text; where
    several rules reject, the name follows the order and may differ between runs, the verdict does not).

    Null and empty texts have no words and fail the base rule.  Each row is judged alone, so repeated rows, ties and
    other columns do not matter, and an empty table gives no rows.
    """
    rules = RULES if rules is None else rules
    order = cascade_order(docs, rules, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = [(name, rules[name]) for name in order]
        for batch in batches:
            rows = []
            for data in as_bytes(batch.column(1)):
                t = measure(data)
                failed = base_failed(t)
                by = "base" if failed else next((name for name, rejects in cascade if rejects(t)), None)
                rows.append(
                    (len(t.words), t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, by, by is None)
                )
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.string(), pa.bool_()]
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=NAMES
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, rejected_by string, kept boolean",
    )


NAMES = [
    "doc_id",
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "base_failed",
    "rejected_by",
    "kept",
]


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(documents(spark, folder)).drop("rejected_by")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS w
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) > 8)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM win) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id
), one AS (
  SELECT doc_id, max(n) AS most
  FROM (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY doc_id, w) GROUP BY doc_id
), c AS (
  SELECT d.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(ls) AS n_lines,
         len(list_filter(ws, lambda w: regexp_matches(w, '[A-Za-z]|[^\x00-\x7F]'))) AS lettered,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS upper_case, coalesce(most, 0) AS most
  FROM d LEFT JOIN covered ON covered.doc_id = d.doc_id LEFT JOIN one ON one.doc_id = d.doc_id
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 10 * n_symbols > n_words
            OR 10 * n_dup_lines > 3 * n_lines OR 10 * lettered < 7 * n_words OR 2 * upper_case > word_chars
            OR 4 * most > n_words) AS kept
FROM b
"""
