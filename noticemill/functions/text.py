"""Evidence text: which lines of a notice describe the goods being bought."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import any_of, java, let, matches

# Section headings inside notice documents.
TECHNICAL_HEADING = r"^(?:.*\/\s*)?(?:technical|product|item)\s+specifications?\b"
ADMINISTRATIVE_PHRASE = (
    r"(?:buyer added bid specific|consignees\/reporting|general terms and conditions"
    r"|additional terms and conditions)"
)
ADMINISTRATIVE_LINE = (
    r"^\s*(?:\d+[.)]\s*)?(?:generic|help(?: centre| center)?|procurement history|bid history"
    r"|terms (?:and|&) conditions|eligibility criteria|warranty|disclaimer)\s*:?(?:\s*$)"
)
DISCOVERY_PHRASE = (
    r"GeMARPTS|searched\s+(?:strings|results?)|result generated|categories selected for notification"
)
ITEM_END_PHRASE = (
    r"GeMARPTS|searched|categories selected|minimum average|OEM average|years of past|turnover"
    r"|document required|MSE relaxation|startup relaxation|bid number|bid end date|buyer added|consignees"
)
BID_DOCUMENT = (
    r"GeMARPTS|\bBid Details\b[\s\S]*\bItem Category\b|\bItem Category\b[\s\S]*\bBid Number\b"
)
ITEM_LABEL = r"\bItem Category\b"
NOT_AN_ITEM_VALUE = r"total quantity|bid details|office name|email"
# Wording that describes where an item is used, not the item.
CLINICAL_AREA = (
    r"(?:anaesthe\w*(?: (?:machine|workstation))?|anesthe\w*(?: (?:machine|workstation))?|radiology"
    r"|radiography|x[ -]?ray(?: machine)?|ultrasound(?: machine)?|mri(?: machine)?|ct(?: scanner)?"
    r"|endoscop\w*|laparoscop\w*|bronchoscop\w*|icu|critical care|ot|operation theatre|operating theatre"
    r"|patient monitoring|monitoring|ventilator)"
)
SECURITY_SCANNER = (
    r"\b(?:(?:x[ -]?ray|ct)\s+)?(?:baggage|luggage|cargo|parcel|security)\s+(?:(?:x[ -]?ray|ct)\s+)?"
    r"(?:scanners?|scanning (?:systems?|machines?)|screening (?:systems?|machines?))\b"
)
BUYER_LINE = (
    r"^\s*(?:department|deptt?|location|buyer|organisation(?: chain)?|office name|hospital name)\s*:[^\n]*"
)
DEPARTMENT_OF_AREA = r"\b(?:department|deptt?\.?)\s+(?:of{1,2}|for)\s+(?:the\s+)?" + CLINICAL_AREA + r"\b"
AREA_ROOM = r"\b" + CLINICAL_AREA + r"\s+(?:department|deptt?\.?|room|ward|block|wing|area|opd)\b"

_MARK = "\x01"


def lines_of(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")


ADMINISTRATIVE = any_of([ADMINISTRATIVE_PHRASE, ADMINISTRATIVE_LINE, DISCOVERY_PHRASE])
LOOK_BACK = 4  # an item's value may stand so many lines above its label


def _sections(tagged: Column, keep: Callable[[Column, Column], Column]) -> Column:
    """Lines of the kept sections, joined.

    A tagged line opens a section; ``keep`` picks the sections from the whole array, the one before any mark first
    and untagged.  Each section but the last ends with the line feed in front of the next mark.
    """
    pieces = F.split(F.array_join(tagged, "\n"), _MARK)

    def trimmed(p: Column) -> Column:
        cut = F.transform(
            p, lambda x, i: F.when(i < F.size(p) - 1, F.substr(x, F.lit(1), F.greatest(F.length(x) - 1, F.lit(0)))).otherwise(x)
        )
        return keep(cut, F.length(F.get(p, F.lit(0))) > 0)

    return F.array_join(let(pieces, trimmed), "\n")


def _plain_evidence(lines: Column) -> Column:
    tagged = F.transform(
        lines,
        lambda x: F.when(matches(x, TECHNICAL_HEADING), F.concat(F.lit(_MARK + "T"), x))
        .when(matches(x, ADMINISTRATIVE), F.concat(F.lit(_MARK + "A"), x))
        .otherwise(x),
    )

    def kept(p: Column, opened: Column) -> Column:
        technical = F.transform(
            F.filter(F.slice(p, F.lit(2), F.size(p)), lambda x: F.startswith(x, F.lit("T"))),
            lambda x: F.substr(x, F.lit(2)),
        )
        return F.concat(F.when(opened, F.slice(p, 1, 1)).otherwise(F.array().cast("array<string>")), technical)

    return _sections(tagged, kept)


def _bid_document_evidence(lines: Column) -> Column:
    def prior(i: Column) -> Column:
        """The nearest worded line above, if it can be the item's value."""
        above = F.slice(lines, F.greatest(i - LOOK_BACK + 1, F.lit(1)), F.least(i, F.lit(LOOK_BACK)))
        return let(
            F.get(F.reverse(F.filter(above, lambda x: matches(x, "[a-z]"))), F.lit(0)),
            lambda x: F.when(x.isNotNull() & ~matches(x, NOT_AN_ITEM_VALUE), F.concat(x, F.lit("\n"))).otherwise(""),
        )

    def tag(x: Column, i: Column) -> Column:
        rest = F.regexp_replace(x, java("^.*?" + ITEM_LABEL), "")
        return (
            F.when(matches(x, ITEM_LABEL), F.concat(F.lit(_MARK + "I"), prior(i), rest))
            .when(matches(x, TECHNICAL_HEADING), F.concat(F.lit(_MARK + "T"), x))
            .when(matches(x, ADMINISTRATIVE), F.concat(F.lit(_MARK + "A"), x))
            .when(matches(x, ITEM_END_PHRASE), F.concat(F.lit(_MARK + "E"), x))
            .otherwise(x)
        )

    start = F.struct(F.lit("").alias("section"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, piece: Column) -> Column:
        mark = F.substring(piece, 1, 1)
        section = (
            F.when(mark.isin("I", "T"), mark).when((mark == "E") & (state["section"] == "T"), F.lit("T")).otherwise("")
        )
        body = F.array(F.substr(piece, F.lit(2)))
        return F.struct(
            section.alias("section"), F.when(section != "", F.concat(state["kept"], body)).otherwise(state["kept"]).alias("kept")
        )

    def kept(p: Column, _opened: Column) -> Column:
        return F.aggregate(F.slice(p, F.lit(2), F.size(p)), start, step, lambda s: s["kept"])

    return _sections(F.transform(lines, tag), kept)


def without_marks(text: Column) -> Column:
    return F.translate(text, _MARK, "")


def product_evidence(text: Column) -> Column:
    """Text without administrative sections; bid documents keep item and technical sections only.

    Headings are looked for line by line.
    """
    clean = without_marks(F.regexp_replace(text, "\r\n?", "\n"))

    def evidence(t: Column) -> Column:
        return let(
            F.split(t, "\n"),
            lambda lines: F.when(matches(t, BID_DOCUMENT), _bid_document_evidence(lines)).otherwise(_plain_evidence(lines)),
        )

    return let(clean, evidence)


def without_clinical_context(text: Column) -> Column:
    """Remove named rooms, departments and buyer lines, and security scanners."""
    t = F.regexp_replace(text, java(SECURITY_SCANNER), " ")
    t = F.regexp_replace(t, java(BUYER_LINE, "im"), "")
    t = F.regexp_replace(t, java(DEPARTMENT_OF_AREA), " ")
    return F.regexp_replace(t, java(AREA_ROOM), " ")


# --- display and outbound text -------------------------------------------------

_CONTROL = r"\p{Cc}"


def display_text(text: Column) -> Column:
    """Presentable text; empty when nothing readable is left."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), _CONTROL, " ")
    t = F.regexp_replace(t, java(r"(?:^|\s)%+(?=\s|$)", ""), " ")
    t = F.trim(F.regexp_replace(t, java(r"\s+", ""), " "))
    return let(
        t,
        lambda v: F.when(
            matches(v, r"^(?:n\s*\/?\s*a|not available|null|undefined)$") | ~v.rlike(r"[\p{L}\p{N}]"),
            F.lit(""),
        ).otherwise(v),
    )


def description_excerpt(text: Column, length: int = 800) -> Column:
    """Start of a description, up to its technical specification."""
    t = F.split(F.coalesce(text, F.lit("")), java(r"technical\s*specifications?"), 2)[0]
    t = F.trim(F.regexp_replace(F.regexp_replace(t, _CONTROL, " "), java(r"\s+", ""), " "))
    return let(
        t,
        lambda v: F.when(
            F.length(v) > length, F.concat(F.rtrim(F.left(v, F.lit(length))), F.lit("…"))
        ).otherwise(v),
    )


def plain_text(text: Column, length: int = 500) -> Column:
    """Markup-free single-line text for the outbound feed; NULL when empty."""
    t = F.regexp_replace(text, r"<[^>]*>", " ")
    t = F.translate(F.regexp_replace(t, _CONTROL, " "), "<>", "‹›")
    return F.nullif(F.left(F.trim(F.regexp_replace(t, java(r"\s+", ""), " ")), F.lit(length)), F.lit(""))


def whole_quantity(text: Column, maximum: int = 1_000_000) -> Column:
    """Integer quantity between 1 and the maximum, else NULL."""
    t = F.trim(text)
    n = F.when(matches(t, r"^\d+$", ""), t.try_cast("bigint"))
    return F.when(n.between(1, maximum), n.cast("int"))


def label_text(value: Column) -> Column:
    return F.initcap(F.replace(F.lower(value), F.lit("_"), F.lit(" ")))


def document_type(label: Column, url: Column) -> Column:
    text = F.concat_ws(" ", F.coalesce(label, F.lit("")), F.coalesce(url, F.lit("")))
    return (
        F.when(matches(text, r"corrig|amend|addendum|extension"), "corrigendum")
        .when(matches(text, r"\.xlsx?(?:$|\?)|\bboq\b|price schedule|bill of quantit"), "boq")
        .when(matches(text, r"technical|specification|annexure"), "technical-specification")
        .otherwise("tender-document")
    )


def field_between(text: Column, label: str, following: str) -> Column:
    """Printable ASCII text between two field labels; empty when the first is missing."""
    flat = F.regexp_replace(F.regexp_replace(text, r"[^\x20-\x7e\n]", " "), java(r"\s+", ""), " ")
    after = F.get(F.split(flat, _literal(label)), F.lit(1))
    part = F.split(after, _literal(following))[0]
    return F.coalesce(F.trim(F.regexp_replace(part, r"^[ /]+|[ /]+$", "")), F.lit(""))


def _literal(text: str) -> str:
    return r"\Q" + text + r"\E"


def cancelled_words(text: Column) -> Column:
    return matches(text, r"\b(?:cancelled|canceled|cancellation)\b")


def withdrawn_words(text: Column) -> Column:
    return matches(text, r"\b(?:withdrawn|withdrawal)\b")

