"""The whole chain in one plan: raw notices to survivors, counters and audits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import first_present, present
from ..functions.text import product_evidence
from ..operators import quality
from ..operators.classify import MEDICAL, RuleBook, classify, generic_candidate, priority_groups
from ..operators.dedupe import Deduplicated, deduplicate
from ..operators.entities import assign_entities, attributed, procurement_scope
from ..operators.status import current_candidate, read_verification, resolve_status
from ..sources.listings import notice_key
from .lineage import cut


@dataclass
class Dashboard:
    raw: DataFrame
    tenders: DataFrame
    merged: Deduplicated
    funnel: DataFrame
    summary: DataFrame


def attribute_and_classify(raw: DataFrame, entities: DataFrame, book: RuleBook = MEDICAL) -> DataFrame:
    """Raw rows with matched entities, classification and brand matches (one pass each)."""
    work = assign_entities(raw, entities)
    text = F.concat_ws("\n", present(F.col("title")), present(F.col("description")))
    scope = first_present(F.col("document_product_scope"), F.col("title"))
    work = classify(work, text, scope, book=book, out="c", brands=True)
    statewide = F.coalesce(F.col("procurement_scope") == "statewide", F.lit(False))
    return work.withColumns(
        {
            "entity_count": F.size("matched"),
            "is_statewide": statewide,
            "is_relevant": F.col("c.is_relevant"),
        }
    )


def normalise(classified: DataFrame, now: Column, book: RuleBook = MEDICAL, groups: list | None = None) -> DataFrame:
    """Gold rows of attributed, relevant notices."""
    kept = classified.filter(attributed(F.col("matched"), F.col("procurement_scope")) & F.col("is_relevant"))
    stale = F.coalesce(F.col("stale"), F.lit(False))
    checked = read_verification(F.col("verification"), stale, F.col("fetched_at"), now)
    kept = resolve_status(kept, now, verification=checked)
    if groups is None:
        kept = priority_groups(kept, F.col("title"), F.col("document_product_scope"), book=book)
    else:
        kept = priority_groups(kept, F.col("title"), F.col("document_product_scope"), book=book, groups=groups)
    kept = notice_key(kept)
    one = F.when(F.size("matched") == 1, F.get("matched", F.lit(0)))
    reference_type = "array<struct<source_id:string,source_name:string,url:string>>"
    own = F.array(
        F.struct("source_id", "source_name", first_present(F.col("tender_url"), F.col("source_url")).alias("url"))
    ).cast(reference_type)
    return kept.withColumns(
        {
            "region": F.coalesce(present(one["region"]), F.col("region")),
            "institution_id": one["id"],
            "institution_name": one["short_name"],
            "consignees": F.when(
                F.size("matched") > 0,
                F.transform("matched", lambda m: F.struct(m["id"].alias("institution_id"), m["short_name"].alias("name"))),
            ).otherwise(F.col("consignees")),
            "procurement_scope": procurement_scope(F.col("matched")),
            "categories": F.col("c.categories"),
            "brand_matches": F.col("c.brand_matches"),
            "matched_keywords": F.col("c.matched_keywords"),
            "confidence": F.col("c.confidence"),
            "checked_at": F.col("fetched_at"),
            "stale": stale,
            "source_references": F.when(F.size("source_references") > 0, F.col("source_references")).otherwise(own),
        }
    ).drop("matched", "c", "entity_count", "is_statewide", "is_relevant")


# Columns of a bronze notice; missing ones are added as NULL.
BRONZE = {
    "id": "string", "title": "string", "description": "string", "region": "string", "institution_id": "string",
    "procurement_scope": "string", "source_id": "string", "source_name": "string", "source_url": "string",
    "tender_url": "string", "tender_id": "string", "reference_number": "string", "organisation": "string",
    "organisation_chain": "array<string>", "department": "string", "buyer": "string", "location": "string",
    "publish_date": "string", "original_closing_date": "string", "extended_closing_date": "string",
    "bid_opening_date": "string", "cancelled": "boolean", "withdrawn": "boolean",
    "corrigenda": "array<struct<title:string,type:string,published_date:string,revised_closing_date:string,url:string>>",
    "documents": "array<struct<label:string,url:string>>",
    "source_references": "array<struct<source_id:string,source_name:string,url:string>>",
    "consignees": "array<struct<institution_id:string,name:string>>",
    "equipment_items": "array<struct<id:string,name:string,quantity_text:string,category:string,source_url:string,"
    "source_label:string,source_page:int,source_sheet:string,source_row:int>>",
    "tender_category": "string", "product_category": "string", "procurement_category": "string",
    "work_category": "string", "document_product_scope": "string", "verification": "string",
    "date_precision": "string", "notes": "array<string>", "fetched_at": "string", "stale": "boolean",
}


def bronze(df: DataFrame) -> DataFrame:
    """Complete a notice table to the bronze schema; needs notice_key and ordinal."""
    missing = {c: F.lit(None).cast(t) for c, t in BRONZE.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def build_dashboard(
    raw: DataFrame, entities: DataFrame, now: Column, book: RuleBook = MEDICAL, groups: list | None = None
) -> Dashboard:
    """Attribute, classify, resolve, merge and count. The clock is one fixed value."""
    classified = attribute_and_classify(bronze(raw), entities, book)
    # Read by the merge, the funnel and the audits: write it once.
    classified = cut(classified)
    tenders = cut(normalise(classified, now, book, groups))
    merged = deduplicate(tenders, now)
    funnel = quality.source_funnel(classified)
    return Dashboard(classified, tenders, merged, funnel, quality.summary(funnel, merged.survivors))


def audit_evidence(raw: DataFrame, book: RuleBook = MEDICAL, groups: list | None = None) -> DataFrame:
    """Raw rows with evidence text, its classification and priority groups, once per row."""
    scope = product_evidence(first_present(F.col("document_product_scope"), F.col("title")))
    work = raw.withColumn("evidence", scope)
    work = classify(work, F.col("evidence"), book=book, out="ec")
    kwargs = {} if groups is None else {"groups": groups}
    work = priority_groups(work, F.col("title"), F.col("document_product_scope"), book=book, **kwargs)
    return work.withColumn("is_relevant", F.col("ec.is_relevant")).drop("ec")


def candidate_flags(tenders: DataFrame, now: Column) -> DataFrame:
    """Current and generic flags on rows with a resolved status."""
    return tenders.withColumns({"is_current": current_candidate(tenders, now), "is_generic": generic_candidate(tenders)})
