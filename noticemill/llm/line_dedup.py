"""Line dedup: drop lines whose normalised form also stands in other documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .common import ASCII_SPACE, as_bytes, carried, documents, id_key, original_id, uncarried


def line_key(line: bytes, min_points: int) -> bytes | None:
    """128-bit hash of the normalised line; None for a line too short to be judged."""
    key = line.strip(ASCII_SPACE).lower()  # on bytes both touch ASCII only
    if len(key) < min_points or (len(key) < 4 * min_points and len(key.decode("utf-8", "replace")) < min_points):
        return None
    return xxhash.xxh3_128_digest(key)


def line_dedup(
    docs: DataFrame, min_points: int = 10, min_documents: int = 2, carry: list[str] | None = None
) -> DataFrame:
    """(doc_id, kept_text, n_lines, n_dropped and the columns to carry along), one row per input row.

    A line's key is the line without ASCII white space at both ends and with A-Z lower-cased.  Keys of at least
    ``min_points`` code points held by ``min_documents`` distinct documents or more lose all their lines except in the
    smallest doc_id that holds them.  Kept lines are joined by line feeds in their old order.

    Null and empty texts are one empty line.  A line repeated inside one document only is kept.  Rows with the same
    doc_id count as one document; null ids count as one document after all others.  Other columns are ignored, and an
    empty table gives an empty result.

    Only hashes are counted: one row per distinct key of a document.  The counts combine map-side, a key held by very
    many documents is met by the skew handling of the join, and texts are shuffled once to meet their dropped keys.
    """
    carry = carry or []
    base = docs.select(id_key().alias("key_"), F.col("text").cast("string").alias("text"), carried(docs, carry))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = [], []
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                found = {line_key(line, min_points) for line in text.split(b"\n")} - {None}
                ids.extend([doc] * len(found))
                hashes.extend(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes, pa.binary()), pa.array(ids, pa.int64())], names=["hash", "key_"]
            )

    held = base.select("key_", "text").mapInArrow(keys, "hash binary, key_ long")
    if min_documents == 2:
        counted = held.groupBy("hash").agg(F.min("key_").alias("first"), F.max("key_").alias("last"))
        repeated = counted.filter("first < last").select("hash", "first")
    else:
        counted = held.distinct().groupBy("hash").agg(F.min("key_").alias("first"), F.count("*").alias("n"))
        repeated = counted.filter(F.col("n") >= min_documents).select("hash", "first")
    dropped = (
        held.join(cut(repeated), "hash")
        .filter("key_ <> first")
        .groupBy("key_")
        .agg(F.collect_set("hash").alias("drops"))
    )

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, drops in zip(as_bytes(batch.column(1)), batch.column(3).to_pylist(), strict=True):
                lines = text.split(b"\n")
                if drops:
                    drops = set(drops)
                    kept = [line for line in lines if line_key(line, min_points) not in drops]
                    rows.append((b"\n".join(kept), len(lines), len(lines) - len(kept)))
                else:
                    rows.append((text, len(lines), 0))
            texts, lines, gone = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                    pa.array(lines, pa.int64()),
                    pa.array(gone, pa.int64()),
                    batch.column(2),
                ],
                names=["key_", "kept_text", "n_lines", "n_dropped", "carry_"],
            )

    kind = base.schema["carry_"].dataType.simpleString()
    out = base.join(dropped, "key_", "left").mapInArrow(
        reassemble, f"key_ long, kept_text string, n_lines long, n_dropped long, carry_ {kind}"
    )
    return out.select(
        original_id("key_").alias("doc_id"), "kept_text", "n_lines", "n_dropped", *uncarried(carry)
    )


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup(documents(spark, folder)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(generate_series(1, len(parts))) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT k.doc_id, k.pos, k.line, r.key IS NULL OR r.first = k.doc_id AS stays
  FROM keyed k LEFT JOIN repeated r ON r.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
