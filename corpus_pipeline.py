"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticemill.llm.common import documents, id_key
from noticemill.llm.line_dedup import line_dedup
from noticemill.llm.near_dedup import near_duplicates
from noticemill.llm.packing import pack, token_pieces
from noticemill.llm.quality_model import good_documents
from noticemill.llm.suffix_dedup import repeated_passages
from noticemill.plans.lineage import cut

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
KEPT = ["lang", "source"]


def _as_documents(df: DataFrame, text: str) -> DataFrame:
    return df.select("doc_id", F.col(text).alias("text"), *KEPT, F.length(text).cast("long").alias("n_chars"))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts are scored as texts without words; rows that repeat an id are judged each by its own text; null
    ids teach nothing.  An empty table gives none.
    """
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return good_documents(docs, labels, threshold=0.3)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; every row stays, with its lang and source.

    A null text becomes empty.  Rows with one id, or with a null one, count as one document and keep their lines.
    """
    return _as_documents(line_dedup(docs, carry=KEPT), "kept_text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; rows that share a doc_id stay or go together.

    Null, empty and wordless texts are like no other and stay.  Null ids stand after all others.
    """
    kept = near_duplicates(docs, percent=80).filter("kept").select(id_key().alias("key_")).distinct()
    return docs.withColumn("key_", id_key()).join(kept, "key_", "left_semi").select(*docs.columns)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 100 bytes that start earlier; only whole characters go; every row stays."""
    found = repeated_passages(docs, 100, characters=True, carry=KEPT)
    return _as_documents(found.withColumn("kept", F.decode("kept", "UTF-8")), "kept")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids placed in sequences of 1024; an empty text is its end mark alone."""
    import public_tokenizers

    pieces = token_pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), 1024, keep_ids=False)
    return pack(pieces, 1024).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", classify),
    ("line dedup", drop_lines),
    ("near-dedup", drop_near_duplicates),
    ("suffix-array dedup", drop_passages),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # the classifier and the shingle links have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the checkpoint folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
