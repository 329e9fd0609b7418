"""Notice identifiers found in text, and the keys records are compared on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import extract, java, let, matches, occurrences, replace

# Identifier formats.
ANY_NOTICE_ID = r"GEM\s*\/\s*\d{4}\s*\/\s*[A-Z]\s*\/\s*\d+|\b20\d{2}_[A-Z0-9]+_\d+_\d+\b"
BID_ID = r"GEM\s*\/\s*\d{4}\s*\/\s*[A-Z]\s*\/\s*\d+"
STRICT_BID_ID = r"GEM\s*\/\s*20\d{2}\s*\/\s*[BR]\s*\/\s*\d+"
COMPACT_BID_ID = r"GEM\/\d{4}\/B\/\d+"
PORTAL_ID = r"\b20\d{2}_[A-Z0-9]+_\d+_\d+\b"
PRINTED_BID_ID = r"\bGEM[\/-](\d{4})[\/-]([BR])[\/-](\d+)\b"
ITEM_REFERENCE = (
    r"^(?:(?:E-Tender|Global Tender Enquiry)\s+Notice\s+No\.?\s*)?"
    r"(PI\(EP\)\/\d{2}-\d{2}\/(?:G\/)?\d+\/\d+)$"
)
BATCH_REFERENCE = r"PI\s*\(\s*EP\s*\)\s*\/?\s*(\d{2})\s*-\s*(\d{2})\s*[/-]\s*(?:(G)\s*[/-]\s*)?(\d+)\b"


def present(value: Column) -> Column:
    """Empty text counts as missing."""
    return F.nullif(value, F.lit(""))


def first_present(*values: Column) -> Column:
    return F.coalesce(*[present(v) for v in values])


def notice_ids(text: Column, pattern: str = ANY_NOTICE_ID) -> Column:
    """Distinct identifiers in the text, upper case and without spaces."""
    return F.array_distinct(
        F.transform(occurrences(text, pattern), lambda s: F.upper(F.regexp_replace(s, java(r"\s", ""), "")))
    )


def identity_agrees(notice_id: Column, text: Column) -> Column:
    """A document belongs to a notice unless it names only other notices."""
    agrees = let(
        notice_ids(text), lambda ids: (F.size(ids) == 0) | F.array_contains(ids, F.upper(notice_id))
    )
    return present(notice_id).isNull() | agrees


def printed_bid_id(*fields: Column) -> Column:
    found = F.get(occurrences(F.concat_ws(" ", *[present(f) for f in fields]), PRINTED_BID_ID), F.lit(0))
    return F.upper(F.replace(found, F.lit("-"), F.lit("/")))


def item_reference(reference: Column) -> Column:
    return F.upper(extract(F.trim(reference), ITEM_REFERENCE, 1))


def batch_reference(text: Column) -> Column:
    """Canonical batch reference such as ``PI(EP)/25-26/G/14``."""
    whole = java("^.*?" + BATCH_REFERENCE + ".*$", "is")
    canonical = F.regexp_replace(text, whole, "PI(EP)/$1-$2/$3/$4")
    return F.when(
        matches(text, BATCH_REFERENCE), F.upper(F.replace(canonical, F.lit("//"), F.lit("/")))
    )


def identity_key(text: Column) -> Column:
    """Lower case letters and digits only; missing text gives an empty key."""
    return F.coalesce(F.regexp_replace(F.lower(text), "[^a-z0-9]", ""), F.lit(""))


def alias_key(text: Column) -> Column:
    """Space-separated lower case words, ``&`` read as ``and``."""
    return F.trim(
        F.regexp_replace(F.regexp_replace(F.lower(text), "&", " and "), "[^a-z0-9]+", " ")
    )


def calendar_prefix(text: Column) -> Column:
    return F.coalesce(F.substring(text, 1, 10), F.lit(""))


def surrogate_key(identity: Column) -> Column:
    return F.substring(F.sha2(identity, 256), 1, 20)


def joined_identity(*fields: Column) -> Column:
    """Fields joined by ``|``; a missing field leaves an empty slot."""
    return F.concat_ws("|", *[F.coalesce(f, F.lit("")) for f in fields])


def retender_signature(title: Column) -> Column:
    words = r"re[ -]?tender|fresh tender|re.invited|recalled|reissued"
    return F.regexp_replace(replace(F.lower(title), words, ""), "[^a-z0-9]", "")
