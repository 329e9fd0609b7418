"""Fill-in-middle: a regular expression with counted quantifiers cuts a text in three and puts the parts in new order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = "(?s:.)"  # one code point
BLOCK = 256  # units that are counted as one match
SHAPES = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
GROUP = {PREFIX: 1, MIDDLE: 2, SUFFIX: 3}


def count_units(text: Column) -> Column:
    """Code points of a text: whole blocks are counted first, then the units after the last block.

    The matches that are counted hold the text once, whatever its length.
    """
    block = f"{UNIT}{{{BLOCK}}}+"
    rest = F.regexp_replace(text, rf"\A(?:{block})*+", "")
    return (F.regexp_count(text, F.lit(block)) * BLOCK + F.regexp_count(rest, F.lit(UNIT))).cast("long")


def draws(doc_id: Column, salt: str, n: int = 4) -> list[Column]:
    """The first 8-digit groups of sha256 of ``salt``, a colon and the decimal id, as unsigned integers; null id: empty."""
    name = F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("long").cast("string"), F.lit("")))
    digest = F.sha2(name.cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(n)]


def rebuilt(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from; no marker can arise where parts and markers meet."""
    out = output
    for shape, marks in SHAPES.items():
        at = {m: i + 1 for i, m in enumerate(marks)}
        pattern = rf"(?s)\A{marks[0]}(.*?){marks[1]}(.*?){marks[2]}(.*)\z"
        back = "".join(f"${at[m]}" for m in (PREFIX, MIDDLE, SUFFIX))
        out = F.when(form == shape, F.regexp_replace(output, pattern, back)).otherwise(out)
    return out


def fill_in_middle(docs: DataFrame, salt: str = "1", percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), one row per input row.

    Units are code points.  A document's id alone draws two cuts from 0 to n, whether it is transformed (``percent`` in
    100) and whether the suffix comes first (``spm_percent`` in 100 of those).  Empty texts and texts that hold one of
    the markers stay ``plain``, with null cuts.

    A null text counts as empty; null ids draw as an empty id; rows that repeat a doc_id are cut at the same draws, each
    by its own length; other columns are ignored and an empty table gives no rows.

    The pattern of a row counts its units, so one match captures all three parts and its replacement puts them in
    order.  Possessive counts never go back, so the match is linear in the text.  There is no shuffle and no Python.
    """
    drawn = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(
        "doc_id", "text", count_units(F.col("text")).alias("n"), F.array(draws(F.col("doc_id"), salt)).alias("h")
    )
    first, second = (F.col("h")[i] % (F.col("n") + 1) for i in (0, 1))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.col("text").contains(mark)
    plain = (F.col("n") == 0) | marked | (F.col("h")[2] % 100 >= percent)
    cuts = drawn.select(
        "doc_id",
        "text",
        "n",
        F.least(first, second).alias("a"),
        F.greatest(first, second).alias("b"),
        F.when(plain, "plain").when(F.col("h")[3] % 100 < spm_percent, "spm").otherwise("psm").alias("form"),
    )
    a, middle = F.col("a").cast("string"), (F.col("b") - F.col("a")).cast("string")
    pattern = F.concat(
        F.lit(rf"\A({UNIT}{{"), a, F.lit(rf"}}+)({UNIT}{{"), middle, F.lit(rf"}}+)({UNIT}*+)\z")
    )
    order = F.lit(None).cast("string")
    for shape, marks in SHAPES.items():
        order = F.when(F.col("form") == shape, "".join(f"{m}${GROUP[m]}" for m in marks)).otherwise(order)
    moved = F.col("form") != "plain"
    return cuts.select(
        "doc_id",
        "n",
        "form",
        F.when(moved, F.col("a")).alias("prefix_chars"),
        F.when(moved, F.col("b") - F.col("a")).alias("middle_chars"),
        F.when(moved, F.regexp_replace("text", pattern, order)).otherwise(F.col("text")).alias("output"),
    )


def op11_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    def digest(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    return fill_in_middle(documents(spark, folder)).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(rebuilt(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h
  FROM documents
), k AS (
  SELECT doc_id, text, n,
         least(('0x' || substr(h, 1, 8))::BIGINT % (n + 1), ('0x' || substr(h, 9, 8))::BIGINT % (n + 1)) AS a,
         greatest(('0x' || substr(h, 1, 8))::BIGINT % (n + 1), ('0x' || substr(h, 9, 8))::BIGINT % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT *, substr(text, 1, a) AS head, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS tail FROM k
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || middle
                        ELSE '<S>' || tail || '<P>' || head || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
