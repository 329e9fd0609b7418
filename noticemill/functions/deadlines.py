"""Labelled submission deadlines inside document text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import day_only, instant, parse_listing_date
from .patterns import extract, java, let, matches

# Label wording, wording before a label that disqualifies it, and
# the date shapes accepted after a label.
SUBMISSION_LABEL = (
    r"\b(?:(?:revised|extended|new)\s+)?(?:bid\s+(?:submission\s+)?end\s+date(?:\s*(?:\/|&|and)\s*time)?"
    r"|(?:bid\s+)?submission\s+(?:end\s+date|deadline)"
    r"|closing\s+date(?:\s*(?:\/|&|and)\s*time)?"
    r"|last\s+date(?:\s+of\s+receiving\s+quotations?)?(?:\s*(?:\/|&|and)\s*time)?"
    r"(?:\s+(?:for|of)\s+(?:bid\s+|tender\s+)?submission(?:\s+of\s+(?:bids?|tenders?))?)?"
    r"|due\s+date|end\s+date)\b"
)
OTHER_DATE_BEFORE_LABEL = (
    r"(?:download|document\s+sale|bid\s+opening|opening\s+of\s+bids?"
    r"|(?:warranty|guarantee|cmc|amc|maintenance|contract|delivery|payment)(?:\s+period)?)\s*$"
)
LABELLED_DATE = (
    r"^(?:\d{4}-\d{2}-\d{2}(?:[T ]\d{1,2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:\d{2})?)?"
    r"|\d{1,2}[-/. ](?:\d{1,2}|[A-Za-z]{3,9})[-/. ,]+\d{4}(?:\s+\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM)?)?)(?!\d)"
)
LABELLED_TIME = r"^,?\s*Time\s*:?\s*(\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM)?)\b"
AFTER_LABEL_PUNCTUATION = r"^[\s:;=\-–/()ऀ-ॿ]+"
AFTER_LABEL_WORDS = r"^,?\s*i\.e\.,?\s*on\s+"
REVISED = r"^(?:revised|extended|new)\b"
LOOK_BACK, LOOK_AHEAD = 65, 140

_START, _END = "\x01", "\x02"


def _labels(text: Column) -> Column:
    """array<struct<before,label,after>>, one entry per label in text order."""
    marked = F.regexp_replace(
        F.translate(text, _START + _END + " ", "   "),
        java(SUBMISSION_LABEL),
        _START + "$0" + _END,
    )
    return let(F.split(marked, _START), _label_contexts)


def _label_contexts(pieces: Column) -> Column:
    def plain(part: Column) -> Column:
        return F.translate(part, _END, "")

    def context(i: Column) -> Column:
        own = F.split(F.element_at(pieces, i + 1), _END)
        # Labels are at least eight characters, so 18 pieces always cover the look-ahead.
        return F.struct(
            F.right(
                plain(F.array_join(F.slice(pieces, F.greatest(i - 9, F.lit(1)), F.least(i, F.lit(10))), "")),
                F.lit(LOOK_BACK),
            ).alias("before"),
            F.get(own, F.lit(0)).alias("label"),
            F.left(
                F.concat(F.get(own, F.lit(1)), plain(F.array_join(F.slice(pieces, i + 2, 18), ""))),
                F.lit(LOOK_AHEAD),
            ).alias("after"),
        )

    count = F.size(pieces) - 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), context)).otherwise(
        F.expr("cast(array() as array<struct<before:string,label:string,after:string>>)")
    )


def _submission_labels(text: Column) -> Column:
    return F.filter(_labels(text), lambda m: ~matches(m["before"], OTHER_DATE_BEFORE_LABEL))


def has_deadline_label(text: Column) -> Column:
    """True when the text has at least one submission-deadline label."""
    return F.when(matches(text, SUBMISSION_LABEL), F.size(_submission_labels(text)) > 0).otherwise(False)


def _read(m: Column) -> Column:
    rest = F.regexp_replace(
        F.regexp_replace(m["after"], java(AFTER_LABEL_PUNCTUATION, ""), ""), java(AFTER_LABEL_WORDS), ""
    )

    def dated(part: Column) -> Column:
        shown, tail = part["shown"], part["tail"]
        later_time = extract(tail, LABELLED_TIME, 1)
        return F.when(
            day_only(shown) & later_time.isNotNull(), F.concat(shown, F.lit(" "), later_time)
        ).otherwise(shown)

    def split_date(r: Column) -> Column:
        return F.struct(
            extract(r, LABELLED_DATE).alias("shown"),
            F.regexp_replace(r, java(LABELLED_DATE), "").alias("tail"),
        )

    full = let(let(rest, split_date), dated)
    return let(
        full,
        lambda f: F.struct(
            parse_listing_date(f, day_only(f)).alias("date"),
            F.when(day_only(f), F.lit("day")).otherwise(F.lit("minute")).alias("date_precision"),
            m["label"].alias("label"),
            matches(m["label"], REVISED).alias("revised"),
        ),
    )


def _agreed(read: Column) -> Column:
    revised = F.filter(read, lambda c: c["revised"])

    def pick(chosen: Column) -> Column:
        agree = F.size(F.array_distinct(F.transform(chosen, lambda c: instant(c["date"])))) == 1
        first = F.get(chosen, F.lit(0))
        return F.when(
            agree,
            F.struct(
                first["date"].alias("date"),
                first["date_precision"].alias("date_precision"),
                first["label"].alias("label"),
            ),
        )

    return let(F.when(F.size(revised) > 0, revised).otherwise(read), pick)


def submission_deadline(text: Column) -> Column:
    """struct<date,date_precision,label> when the labelled dates agree, else NULL.

    Revised labels outrank the others; two different instants give NULL.
    """

    def read(t: Column) -> Column:
        dated = F.filter(F.transform(_submission_labels(t), _read), lambda c: c["date"].isNotNull())
        return F.when(matches(t, SUBMISSION_LABEL), let(dated, _agreed))

    return let(text, read)
