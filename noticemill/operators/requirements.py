"""Requirement clauses from document pages, with amendment supersession.

Everything is relational.  The supersession rule looks sequential, but whether an
amendment replaces exactly one clause only depends on the first clause of its
subject and the first competing one, so it is settled with ordered aggregates
instead of a per-notice loop.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import instant
from ..functions.identifiers import identity_agrees, present
from ..functions.patterns import any_of, extract, java, let, matches
from ..functions.text import product_evidence
from ..plans.lineage import cut
from ..sources import medical_rules as rules
from .classify import MEDICAL, classify, priority_groups
from .ranking import first_rows

# Wording rules for clauses.
AMENDMENT_WORDING = r"read as|replac\w*|amend\w*|revis\w*|instead of|changed to"
SUBJECT_END = (
    r"\b(?:shall|must|should|amend\w*|revis\w*|replac\w*|read as|instead of|changed to|is|are)\b|[:=]|\d"
)
DISCOVERY_START = r"searched (?:strings|result)|gemarpts|categories selected for notification"
DISCOVERY_END = (
    r"minimum average|oem average|technical specifications?|bidder eligibility|additional terms|buyer added"
)
HEADER_CELL = r"^(?:item description|description of item|specification|quantity|qty|unit|consignee)$"
PAGE_MARK = r"^(?:page \d+|-- \d+ of \d+ --)$"
AFTER_WARRANTY = (
    r"(?:post[\s-]*warranty|after\s+(?:satisfactory\s+completion\s+of\s+)?warranty"
    r"|completion\s+of\s+warranty|uptime\s+warranty)"
)
OPTIONAL_WORDS = r"\b(?:optional|not required|not mandatory)\b"
MANDATORY_WORDS = r"\b(?:shall|must|required|mandatory)\b"
LABELLED_QUANTITY = r"\b(?:qty|quantity)\s*[.:=]?\s*(\d+(?:\.\d+)?)"
COUNTED_QUANTITY = r"\b(\d+(?:\.\d+)?)\s*(?:units?|nos?\.?|pieces?|sets?)\b"
PACK_QUANTITY = r"\b(?:pack|package)\s+of\s+(\d+)\b"
NEW_VALUE = r"(?:read as|changed to|replaced (?:by|with))\s*[:–-]?\s*(.+)$"
TECHNICAL_HEADING = r"^\s*(?:\d+[.)]\s*)?technical specifications?\b"
INFUSION_FIELD = "Infusion and syringe delivery"
INFUSION_WORDS = (
    r"\b(?:infusion|syringe|drug library|dose error reduction|anti.bolus|anti.free.flow|keep vein open|kvo)\b"
)
RESPIRATORY_WORDS = r"\b(?:inspiratory|expiratory|respiratory|airway|ventilat\w*)\b"
REQUIREMENT_LENGTH = 1600


@dataclass(frozen=True)
class ClauseBook:
    """Clause rules and wording for one domain."""

    rules: tuple = tuple(rules.CLAUSE_RULES)
    amendment: str = AMENDMENT_WORDING
    subject_end: str = SUBJECT_END
    technical_section: str = "technicalRequirements"
    named_by_match: str = "accessories"

    @property
    def any_rule(self) -> str:
        return any_of([p for _, _, p in self.rules])


def clause_subject(text: Column, book: ClauseBook) -> Column:
    head = F.get(F.split(F.lower(text), java(book.subject_end), 2), F.lit(0))
    return F.trim(F.regexp_replace(head, r"[^a-z]+", " "))


def _no_groups() -> Column:
    return F.array().cast("array<string>")


def clause_lines(pages: DataFrame, book: ClauseBook = ClauseBook()) -> DataFrame:
    """One row per non-empty line: clause text (with its wrapped value) and noise flags.

    ``pages`` has notice_key, doc_url, doc_ordinal, page_ordinal, sheet and text.
    """
    squeezed = F.transform(
        F.split(F.regexp_replace("text", "\r", ""), "\n"),
        lambda s: F.trim(F.regexp_replace(s, java(r"\s+", ""), " ")),
    )
    marked = pages.withColumn("__lines", F.filter(squeezed, lambda s: s != ""))

    def mark(line: Column, i: Column) -> Column:
        state = F.when(matches(line, DISCOVERY_END), 0).when(matches(line, DISCOVERY_START), 1)
        return F.struct(i.alias("i"), state.alias("state"))

    has_mark = any_of([DISCOVERY_START, DISCOVERY_END])
    marks = F.when(
        matches(F.col("text"), has_mark),
        F.filter(F.transform("__lines", mark), lambda m: m["state"].isNotNull()),
    ).otherwise(F.expr("cast(array() as array<struct<i:int,state:int>>)"))
    marked = marked.withColumn("__marks", marks)
    # Only pages that open or close a section matter for the pages after them: a
    # narrow table of intervals, instead of sorting page text per document.
    doc = ["notice_key", "doc_ordinal"]
    states = marked.filter(F.size("__marks") > 0).select(
        *[F.col(c).alias(f"__{c}") for c in doc],
        F.col("page_ordinal").alias("__from"),
        F.try_element_at("__marks", F.lit(-1))["state"].alias("__open"),
    )
    following = Window.partitionBy("__notice_key", "__doc_ordinal").orderBy("__from")
    states = states.withColumn("__to", F.lead("__from").over(following)).filter("__open = 1")
    inside = (
        (F.col("notice_key") == F.col("__notice_key"))
        & (F.col("doc_ordinal") == F.col("__doc_ordinal"))
        & (F.col("page_ordinal") > F.col("__from"))
        & (F.col("__to").isNull() | (F.col("page_ordinal") <= F.col("__to")))
    )
    marked = marked.join(states, inside, "left").withColumn("__carry", F.coalesce("__open", F.lit(0)))
    clauses = F.transform(
        "__lines",
        lambda line, i: F.struct(
            line.alias("line"), F.get(F.col("__lines"), i + 1).alias("next"), i.alias("line_ordinal")
        ),
    )
    rows = marked.withColumn("__c", F.explode(clauses)).select(
        *[c for c in pages.columns if c != "text"],
        "__marks",
        "__carry",
        F.col("__c.line").alias("line"),
        F.col("__c.next").alias("next_line"),
        F.col("__c.line_ordinal").alias("line_ordinal"),
    )
    wraps = (F.length("line") < 100) & F.col("line").rlike(r"[:/]\z") & F.col("next_line").isNotNull()
    text = F.when(
        wraps & ~matches(F.col("next_line"), book.any_rule), F.concat_ws(" ", "line", "next_line")
    ).otherwise(F.col("line"))
    last_mark = F.array_max(F.filter("__marks", lambda m: m["i"] <= F.col("line_ordinal")))["state"]
    header_row = F.coalesce(present(F.col("sheet")).isNotNull(), F.lit(False)) & F.forall(
        F.split("line", r" \| "), lambda c: matches(c, HEADER_CELL)
    )
    noise = (
        (F.coalesce(last_mark, F.col("__carry")) == 1)
        | header_row
        | matches(F.col("line"), PAGE_MARK)
        | (F.length("line") < 3)
    )
    return rows.withColumns({"text": text, "noise": noise}).drop("__marks", "__carry", "line", "next_line")


def rule_hits(lines: DataFrame, book: ClauseBook = ClauseBook(), groups: str | None = None) -> DataFrame:
    """One row per (line, section, field) hit; the first rule for a field wins."""
    text = F.col("text")
    equipment = F.col(groups) if groups else _no_groups()

    def hit(i: int, section: str, field: str, pattern: str) -> Column:
        name = F.lit(field)
        if section == book.named_by_match:
            name = F.coalesce(extract(text, pattern), F.lit(field))
        elif field == INFUSION_FIELD:
            name = (
                F.when(matches(text, INFUSION_WORDS), field)
                .when(matches(text, RESPIRATORY_WORDS), "Ventilation parameters")
                .when(F.array_contains(equipment, "INFUSION_PUMPS"), field)
                .otherwise("Flow and pressure")
            )
        return F.when(
            matches(text, pattern),
            F.struct(F.lit(section).alias("section"), name.alias("field"), F.lit(i).alias("rule_ordinal")),
        )

    found = F.array_compact(F.array(*[hit(i, *r) for i, r in enumerate(book.rules)]))
    gated = lines.filter(matches(text, book.any_rule)).withColumn("__hits", found)
    keys = F.transform("__hits", lambda h: F.concat_ws(":", h["section"], h["field"]))
    firsts = F.filter(
        "__hits", lambda h, i: F.array_position(keys, F.concat_ws(":", h["section"], h["field"])) == i + 1
    )
    return gated.withColumn("h", F.explode(firsts)).select(*[c for c in gated.columns if c != "__hits"], "h.*")


@dataclass
class Requirements:
    clauses: DataFrame
    superseded: DataFrame
    status: DataFrame


def extract_requirements(
    pages: DataFrame,
    documents: DataFrame,
    book: ClauseBook = ClauseBook(),
    groups: str | None = None,
    notices: DataFrame | None = None,
) -> Requirements:
    """Current clauses, superseded clauses and completeness per notice (also of ``notices`` without documents).

    ``documents`` has notice_key, doc_ordinal, doc_url, label, doc_type, doc_status,
    published_date and text_method; ``pages`` has notice_key, doc_ordinal,
    page_ordinal, page, sheet, row and text.
    """
    docs = documents.withColumn("published", instant(F.col("published_date")))
    parsed = docs.filter(F.col("doc_status") == "parsed")
    about = ["doc_url", "label", "doc_type", "published"] + ([groups] if groups else [])
    lines = clause_lines(pages, book).join(
        parsed.select("notice_key", "doc_ordinal", *about), ["notice_key", "doc_ordinal"]
    )
    hits = rule_hits(lines, book, groups)
    amending = (F.col("doc_type") == "corrigendum") & matches(F.col("text"), book.amendment)
    requirement = F.left("text", F.lit(REQUIREMENT_LENGTH))
    early = F.lit("2000-01-01 00:00:00").cast("timestamp")
    hits = hits.withColumns(
        {
            "amending": amending,
            "requirement": requirement,
            "subject": clause_subject(F.col("text"), book),
            "pos": F.struct(
                (F.col("doc_type") == "corrigendum").alias("late"),
                F.coalesce("published", early).alias("at"),
                F.col("doc_ordinal"),
                F.col("page_ordinal"),
                F.col("line_ordinal"),
                F.col("rule_ordinal"),
            ),
        }
    )

    # Every step below reads the hits; the scan of the text happens once.
    hits = cut(hits)

    # Ambiguity: several texts in one amendment, or several amendments without distinct dates.
    scope = ["notice_key", "section", "lower_field", "subject"]
    per_doc = (
        hits.filter("amending")
        .withColumn("lower_field", F.lower("field"))
        .groupBy(*scope, "doc_ordinal")
        .agg(F.min("text").alias("lo"), F.max("text").alias("hi"), F.first("published").alias("at"))
    )
    ambiguous = (
        per_doc.groupBy(*scope)
        .agg(
            F.max(F.col("lo") != F.col("hi")).alias("many"),
            F.count(F.lit(1)).alias("n"),
            F.count_distinct("at").alias("dates"),
        )
        .filter(F.col("many") | ((F.col("n") > 1) & (F.col("dates") != F.col("n"))))
        .select(*scope, F.lit(True).alias("ambiguous"))
    )
    amendments = docs.groupBy("notice_key").agg(
        F.count_if(F.col("doc_type") == "corrigendum").alias("amendment_documents")
    )

    warranty = [p for s, _, p in book.rules if s == "warranty"]
    if warranty:
        remaining = F.regexp_replace("text", java(AFTER_WARRANTY), "")
        after_only = (F.col("section") == "warranty") & ~matches(remaining, any_of(warranty))
    else:
        after_only = F.lit(False)
    items = (
        hits.filter(~F.col("noise") & ~after_only)
        .withColumn("lower_field", F.lower("field"))
        .join(ambiguous, scope, "left")
        .join(amendments, "notice_key")
        .withColumn("ambiguous", F.col("amending") & F.coalesce("ambiguous", F.lit(False)))
        .withColumn(
            "can_replace",
            F.col("amending")
            & ~F.col("ambiguous")
            & (F.col("subject") != "")
            & (F.col("published").isNotNull() | (F.col("amendment_documents") == 1)),
        )
    )
    key = ["notice_key", "section", "field", "subject"]
    starts = items.groupBy(*key).agg(
        F.min("pos").alias("first_pos"),
        F.min_by("requirement", "pos").alias("first_text"),
        F.min(F.when(F.col("can_replace"), F.col("pos"))).alias("first_change"),
    )
    changing = starts.filter(F.col("first_change").isNotNull())
    linked = items.join(changing, key)
    competing = (
        ~F.col("can_replace")
        & (F.col("pos") > F.col("first_pos"))
        & ((F.col("requirement") != F.col("first_text")) | (F.col("pos") > F.col("first_change")))
    )
    rivals = linked.groupBy(*key).agg(F.min(F.when(competing, F.col("pos"))).alias("rival"))
    chain = linked.join(rivals, key).filter(
        (F.col("pos") == F.col("first_pos"))
        | (F.col("can_replace") & (F.col("rival").isNull() | (F.col("pos") < F.col("rival"))))
    )
    then = Window.partitionBy(*key).orderBy("pos")
    detail = F.struct("requirement", "doc_url", "label", "page", "sheet", "row")
    replaced = (
        chain.withColumn("old", F.lag(detail).over(then))
        .filter(F.col("old").isNotNull() & F.col("can_replace"))
        .select(*key, F.col("old.*"), F.col("doc_url").alias("superseded_by"), F.col("pos").alias("replaced_at"), F.col("requirement").alias("replacement"))
    )
    superseded = replaced.select(
        "notice_key", "section", "field", "requirement", "doc_url", "label", "page", "sheet", "row", "superseded_by"
    )
    removed = replaced.groupBy("notice_key", "section", "field", "requirement").agg(
        F.max("replaced_at").alias("replaced_at")
    )
    same = ["notice_key", "section", "field", "requirement"]
    living = items.join(removed, same, "left").filter(
        F.col("replaced_at").isNull() | (F.col("pos") >= F.col("replaced_at"))
    )
    quantity = F.coalesce(
        extract(F.col("text"), LABELLED_QUANTITY, 1),
        extract(F.col("text"), COUNTED_QUANTITY, 1),
        F.when(F.col("section") == book.named_by_match, extract(F.col("text"), PACK_QUANTITY, 1)),
    )
    mandatory = (
        F.when(matches(F.col("text"), OPTIONAL_WORDS), "false")
        .when(matches(F.col("text"), MANDATORY_WORDS), "true")
        .otherwise("unknown")
    )
    value = F.when(F.col("amending"), extract(F.col("text"), NEW_VALUE, 1))
    clauses = first_rows(
        living.select(
            *same, "doc_url", "label", "page", "sheet", "row", "pos",
            value.alias("value"), quantity.alias("quantity"), mandatory.alias("mandatory"),
        ),
        same,
        ["pos"],
    ).withColumnRenamed("pos", "ordinal")

    # A change that replaced nothing although its field was already in use needs review.
    field_start = items.groupBy("notice_key", "section", "field").agg(F.min("pos").alias("field_pos"))
    done = replaced.select(*key, F.col("replaced_at").alias("pos"), F.lit(True).alias("did_replace"))
    review = (
        items.filter("amending")
        .join(field_start, ["notice_key", "section", "field"])
        .join(done, [*key, "pos"], "left")
        .filter(F.col("ambiguous") | (F.col("did_replace").isNull() & (F.col("field_pos") < F.col("pos"))))
        .select("notice_key")
        .distinct()
        .withColumn("needs_review", F.lit(True))
    )
    status = completeness(docs, pages, clauses, review, book, notices)
    return Requirements(clauses, superseded, status)


def completeness(
    documents: DataFrame,
    pages: DataFrame,
    clauses: DataFrame,
    review: DataFrame,
    book: ClauseBook = ClauseBook(),
    notices: DataFrame | None = None,
) -> DataFrame:
    """(notice_key, extraction_status, needs_review) of the notices with documents, and of those in ``notices``.

    A notice without a document is ``not-processed``.
    """
    headed = (
        pages.filter(matches(F.col("text"), TECHNICAL_HEADING, "im"))
        .select("notice_key", "doc_ordinal")
        .distinct()
        .withColumn("headed", F.lit(True))
    )
    parsed = F.col("doc_status") == "parsed"
    facts = (
        documents.join(headed, ["notice_key", "doc_ordinal"], "left")
        .groupBy("notice_key")
        .agg(
            F.max(parsed).alias("any_parsed"),
            F.min(parsed & ~F.coalesce(F.col("text_method") == "reviewed-scan", F.lit(False))).alias("all_read"),
            F.max(
                parsed & ((F.col("doc_type") == "technical-specification") | F.coalesce("headed", F.lit(False)))
            ).alias("technical"),
        )
    )
    technical = (
        clauses.filter(F.col("section") == book.technical_section)
        .select("notice_key")
        .distinct()
        .withColumn("has_clause", F.lit(True))
    )
    if notices is not None:
        facts = facts.join(notices.select("notice_key").distinct(), "notice_key", "full")
    joined = facts.join(review, "notice_key", "left").join(technical, "notice_key", "left")
    complete = (
        F.col("all_read")
        & F.col("needs_review").isNull()
        & F.col("technical")
        & F.coalesce("has_clause", F.lit(False))
    )
    return joined.select(
        "notice_key",
        F.when(F.col("any_parsed").isNull(), "not-processed")
        .when(~F.col("any_parsed"), "document-unavailable")
        .when(complete, "complete")
        .otherwise("partial")
        .alias("extraction_status"),
        F.coalesce("needs_review", F.lit(False)).alias("needs_review"),
    )


# --- document guards and promotion ---------------------------------------------


def guard_identity(documents: DataFrame, tender_id: Column, text: str = "text") -> DataFrame:
    """Documents that name only other notices stay listed, without text."""
    ok = identity_agrees(tender_id, F.col(text))
    return documents.withColumns(
        {
            "doc_status": F.when(ok, F.col("doc_status")).otherwise("unavailable"),
            text: F.when(ok, F.col(text)).otherwise(""),
        }
    )


# Evidence a document must show before its scope replaces a title.
BOQ_HEADING = r"item description|description of item|specification"
SCOPE_HEADING = r"Item Category|^\s*Technical Specifications?"
SCOPE_LENGTH = 28_000


def promote_document_scope(
    notices: DataFrame, pages: DataFrame, documents: DataFrame, generic: str = "is_generic", book=MEDICAL
) -> DataFrame:
    """Give generic notices the product scope their own parsed documents prove.

    Documents per notice are bounded upstream (``document_order``), and what is kept
    is bounded by the scope length.
    """
    usable = documents.filter((F.col("doc_status") == "parsed") & (F.col("doc_type") != "corrigendum"))
    rows = pages.join(usable.select("notice_key", "doc_ordinal", "doc_type"), ["notice_key", "doc_ordinal"])
    rows = rows.join(notices.filter(generic).select("notice_key"), "notice_key", "left_semi")
    boq = priority_groups(rows.filter("doc_type = 'boq'"), F.col("text"), out="__g", book=book)
    boq_rows = boq.filter(matches(F.col("text"), BOQ_HEADING) & (F.size("__g") > 0)).select(
        "notice_key", "doc_ordinal", "page_ordinal", "text"
    )
    full = (
        rows.groupBy("notice_key", "doc_ordinal", "doc_type")
        .agg(F.array_sort(F.collect_list(F.struct("page_ordinal", "text"))).alias("p"))
        .withColumn("text", F.array_join(F.transform("p", lambda x: x["text"]), "\n"))
    )
    evidence = full.select("notice_key", "doc_ordinal", "doc_type", "text", product_evidence(F.col("text")).alias("product"))
    other = evidence.filter((F.col("doc_type") != "boq") & matches(F.col("text"), SCOPE_HEADING, "im")).select(
        "notice_key", "doc_ordinal", F.lit(0).alias("page_ordinal"), F.col("product").alias("text")
    )

    def joined(df: DataFrame, out: str) -> DataFrame:
        return df.groupBy("notice_key").agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("doc_ordinal", "page_ordinal", "text"))), lambda x: x["text"]
                ),
                "\n",
            ).alias(out)
        )

    scopes = joined(boq_rows.unionByName(other), "__scope")
    extra = joined(
        evidence.select("notice_key", "doc_ordinal", F.lit(0).alias("page_ordinal"), F.col("product").alias("text")),
        "__evidence",
    )
    work = notices.join(scopes, "notice_key", "left").join(extra, "notice_key", "left")
    work = classify(work, F.col("__scope"), book=book, out="__c")
    ok = F.col(generic) & present(F.col("__scope")).isNotNull() & F.col("__c.is_relevant")
    return work.withColumns(
        {
            "document_product_scope": F.when(ok, F.left("__scope", F.lit(SCOPE_LENGTH))).otherwise(
                F.col("document_product_scope")
            ),
            "description": F.when(
                ok, F.concat_ws("\n", present(F.col("description")), F.left("__evidence", F.lit(SCOPE_LENGTH)))
            ).otherwise(F.col("description")),
            "is_promoted": F.coalesce(ok, F.lit(False)),
        }
    ).drop("__scope", "__evidence", "__c")


# Fixed value: page marks dropped from a document used as a description.
DESCRIPTION_PAGE_MARK = r"^\s*(?:--\s*\d+\s+of\s+\d+\s*--|page\s+\d+(?:\s+of\s+\d+)?)\s*$"


def document_description(text: Column, length: int = 12_000) -> Column:
    """Document text as a notice description, page marks removed."""
    kept = F.filter(F.split(text, r"\r?\n"), lambda line: ~matches(line, DESCRIPTION_PAGE_MARK))
    return let(
        F.trim(F.array_join(kept, "\n")), lambda t: F.when(t != "", F.left(t, F.lit(length)))
    )


def apply_document_text(notices: DataFrame, documents: DataFrame, length: int = 12_000) -> DataFrame:
    """Use the text of a notice's own document as its description, with two provenance references.

    ``documents`` has one (notice_key, url, text) per notice; a document naming only
    other notices is ignored.
    """
    docs = documents.select("notice_key", F.col("url").alias("__url"), F.col("text").alias("__text"))
    work = notices.join(docs, "notice_key", "left")
    ok = F.col("__text").isNotNull() & identity_agrees(F.col("tender_id"), F.col("__text"))
    kind = "array<struct<source_id:string,source_name:string,url:string>>"
    references = F.array(
        F.struct("source_id", "source_name", F.col("source_url").alias("url")),
        F.struct("source_id", F.lit("Official procurement document").alias("source_name"), F.col("__url").alias("url")),
    ).cast(kind)
    return (
        work.withColumn("__ok", ok)
        .withColumns(
            {
                "description": F.when(
                    F.col("__ok"), F.coalesce(document_description(F.col("__text"), length), F.col("description"))
                ).otherwise(F.col("description")),
                "source_references": F.when(F.col("__ok"), references).otherwise(F.col("source_references")),
                "verification": F.when(F.col("__ok"), "listing").otherwise(F.col("verification")),
            }
        )
        .drop("__url", "__text", "__ok")
    )


def spreadsheet_rows(cells: DataFrame) -> DataFrame:
    """Flatten sheet cells to one text per row; values get the last header's column names.

    ``cells`` has doc_url, sheet, row, column and text (formula cells left out).  A row
    with two or more known headings is a header row.  Header rows are few; each data
    row finds the latest one above it in its own sheet.
    """
    heading = matches(F.trim("text"), r"^(?:item description|description of item|description|specification|quantity|qty|unit|consignee)$")
    rows = cells.groupBy("doc_url", "sheet", "row").agg(
        F.array_sort(F.collect_list(F.struct("column", F.left("text", F.lit(1500)).alias("text")))).alias("cells"),
        F.collect_list(F.when(heading, F.struct("column", F.trim("text").alias("name")))).alias("names"),
    )
    is_header = F.size("names") >= 2
    above = Window.partitionBy("doc_url", "sheet").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("labels", F.last(F.when(is_header, F.col("names")), True).over(above))
    label_of = F.map_from_entries(F.coalesce("labels", F.expr("cast(array() as array<struct<column:int,name:string>>)")))
    parts = F.transform(
        "cells",
        lambda c: F.concat(
            F.when((F.size("names") == 0) & F.try_element_at("__map", c["column"]).isNotNull(),
                   F.concat(F.try_element_at("__map", c["column"]), F.lit(": "))).otherwise(""),
            c["text"],
        ),
    )
    return rows.withColumn("__map", label_of).select("doc_url", "sheet", "row", F.array_join(parts, " | ").alias("text"))
