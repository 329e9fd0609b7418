"""Funnels and audits over raw notices, snapshots and survivors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import instant
from ..functions.identifiers import present
from ..functions.patterns import any_of, matches
from ..sources import medical_rules as rules
from .status import ACTIVE

STATUSES = {
    "active_verified": ["ACTIVE_VERIFIED"],
    "active_likely": ["ACTIVE_LIKELY"],
    "deadline_unknown": ["DEADLINE_UNKNOWN"],
    "expired": ["EXPIRED"],
    "cancelled": ["CANCELLED", "WITHDRAWN"],
}


def status_counts() -> list[Column]:
    return [F.count_if(F.col("status").isin(v)).alias(k) for k, v in STATUSES.items()]


def source_funnel(raw: DataFrame, source: str = "source_id") -> DataFrame:
    """Per source: raw, attributed, relevant, false positives, unassigned.

    Needs ``entity_count``, ``is_statewide`` and ``is_relevant``.  Statewide rows may be
    relevant without being attributed.
    """
    kept = (F.col("entity_count") > 0) | F.col("is_statewide")
    return raw.groupBy(source).agg(
        F.count(F.lit(1)).alias("raw_records"),
        F.count_if(F.col("entity_count") > 0).alias("institution_matches"),
        F.count_if(kept & F.col("is_relevant")).alias("medical_matches"),
        F.count_if(kept & ~F.col("is_relevant")).alias("false_positives_rejected"),
        F.count_if(~kept).alias("unassigned_rejected"),
    )


def summary(funnel: DataFrame, survivors: DataFrame) -> DataFrame:
    """Global counters in one row."""
    totals = funnel.agg(
        F.sum("raw_records").alias("raw_records"),
        F.sum("institution_matches").alias("institution_matched"),
        F.sum("medical_matches").alias("medical_relevant"),
        F.sum("false_positives_rejected").alias("false_positives_rejected"),
        F.sum("unassigned_rejected").alias("unassigned_rejected"),
    )
    final = survivors.agg(*status_counts(), F.count(F.lit(1)).alias("__n"))
    return (
        totals.crossJoin(final)  # one row each
        .withColumn("duplicates_removed", F.col("medical_relevant") - F.col("__n"))
        .drop("__n")
    )


def last_refreshed(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg(F.max(present(F.col("successful_at"))).alias("last_refreshed"))


def entity_sources(entities: DataFrame, sources: DataFrame) -> DataFrame:
    """(entity_id, source_id, status...) for each source an entity relies on."""
    wanted = entities.select(F.col("id").alias("entity_id"), F.explode("source_ids").alias("source_id")).distinct()
    return wanted.join(sources, "source_id")


def entity_notices(tenders: DataFrame) -> DataFrame:
    """(entity_id, notice_key, status): own entity or any consignee, once per notice."""
    ids = F.array_compact(
        F.array_union(
            F.array("institution_id"),
            F.coalesce(F.transform("consignees", lambda c: c["institution_id"]), F.array().cast("array<string>")),
        )
    )
    return tenders.select("notice_key", "status", F.explode(F.array_distinct(ids)).alias("entity_id"))


def entity_records(raw: DataFrame) -> DataFrame:
    """Raw rows by matched entity: one attribution, many groups."""
    return raw.select(
        F.explode(F.transform("matched", lambda m: m["id"])).alias("entity_id"), "is_relevant"
    )


def entity_diagnostics(entities: DataFrame, sources: DataFrame, raw: DataFrame, tenders: DataFrame) -> DataFrame:
    """Per entity: source states, matched and relevant rows, status counts. Zero-filled."""
    per_source = entity_sources(entities, sources).groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("sources_attempted"),
        F.count_if(F.col("status") == "SUCCESS").alias("sources_successful"),
        F.count_if(F.col("status") == "PARTIAL").alias("sources_partial"),
        F.count_if(F.col("status") == "UNAVAILABLE").alias("sources_unavailable"),
        F.sum("raw_records").alias("raw_records"),
    )
    per_raw = entity_records(raw).groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("institution_matches"),
        F.count_if("is_relevant").alias("medical_matches"),
    )
    per_notice = entity_notices(tenders).groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count_if(F.col("status").isin(v)).alias(k) for k, v in STATUSES.items() if k != "cancelled"],
        F.max(F.col("status").isin(ACTIVE)).alias("__active"),
    )
    out = entities.select(F.col("id").alias("entity_id"), F.col("short_name").alias("name"))
    for part in (per_source, per_raw, per_notice):
        out = out.join(part, "entity_id", "left")
    out = out.fillna(0)
    return (
        out.withColumns(
            {
                "false_positives_rejected": F.col("institution_matches") - F.col("medical_matches"),
                "duplicates_removed": F.greatest(F.lit(0), F.col("medical_matches") - F.col("__n")),
                "zero_active_reason": zero_active_reason(
                    F.coalesce("__active", F.lit(False)),
                    F.col("sources_attempted") > F.col("sources_successful"),
                ),
            }
        ).drop("__n", "__active")
    )


def zero_active_reason(has_active: Column, incomplete: Column) -> Column:
    """Code for why an entity shows no active notice; null where it shows one."""
    return (
        F.when(has_active, F.lit(None).cast("string"))
        .when(
            incomplete,
            "none-found-incomplete-coverage",
        )
        .otherwise(
            "none-found-full-coverage"
        )
    )


def entity_cards(entities: DataFrame, sources: DataFrame, tenders: DataFrame) -> DataFrame:
    """Card counts per entity, with statewide active notices of its region and a coverage flag."""
    own = entity_notices(tenders).groupBy("entity_id").agg(
        F.count_if(F.col("status").isin(ACTIVE)).alias("direct_active"),
        F.count_if(F.col("status") == "DEADLINE_UNKNOWN").alias("deadline_unknown"),
        F.count(F.lit(1)).alias("total"),
    )
    regional = (
        tenders.filter(
            (F.col("procurement_scope") == "statewide")
            & present(F.col("institution_id")).isNull()
            & F.col("status").isin(ACTIVE)
        )
        .groupBy("region")
        .agg(F.count(F.lit(1)).alias("regional_active"))
    )
    state = entity_sources(entities, sources).groupBy("entity_id").agg(
        F.max((F.col("status") != "SUCCESS") | F.coalesce("stale", F.lit(False))).alias("__bad")
    )
    return (
        entities.select(F.col("id").alias("entity_id"), "region")
        .join(own, "entity_id", "left")
        .join(regional, "region", "left")
        .join(state, "entity_id", "left")
        .withColumn("incomplete", F.coalesce("__bad", F.lit(True)))
        .drop("__bad")
        .fillna(0, ["direct_active", "deadline_unknown", "total", "regional_active"])
    )


def included_per_source(references: DataFrame) -> DataFrame:
    """Survivors contributing to each source, own or provenance."""
    return references.select("source_id", "notice_key").distinct().groupBy("source_id").agg(
        F.count(F.lit(1)).alias("included")
    )


def omitted_without_region(notices: DataFrame) -> DataFrame:
    """National rows left out because no monitored region was established."""
    return notices.groupBy("source_id").agg(F.count_if(F.col("resolved_region").isNull()).alias("omitted"))


def discovery_metrics(rows: DataFrame, source: str = "source_id") -> DataFrame:
    """Per source: raw candidates per group as a map, and generic/rejected/inspected/deferred counts.

    Needs discovery_groups (array), is_generic, is_title_relevant, is_selected and is_deferred.
    """
    per_group = (
        rows.select(source, F.explode("discovery_groups").alias("grp"))
        .groupBy(source, "grp")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(source)
        # At most one entry per priority group.
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("grp", "n")))).alias("raw_candidates"))
    )
    counts = rows.groupBy(source).agg(
        F.count_if("is_generic").alias("generic_candidates"),
        F.count_if((F.size("discovery_groups") > 0) & ~F.col("is_title_relevant")).alias("rejected_candidates"),
        F.count_if("is_selected").alias("inspected_candidates"),
        F.count_if("is_deferred").alias("deferred_candidates"),
    )
    return counts.join(per_group, source, "left")


def listing_completeness(reported: DataFrame, records: DataFrame, key: str = "tender_id") -> DataFrame:
    """A source whose reported count exceeds its distinct parsed ids is PARTIAL."""
    found = records.groupBy("source_id").agg(F.count_distinct(key).alias("parsed"))
    return reported.join(found, "source_id", "left").withColumns(
        {
            "parsed": F.coalesce("parsed", F.lit(0)),
            "status": F.when(F.col("reported") > F.coalesce("parsed", F.lit(0)), "PARTIAL").otherwise("SUCCESS"),
        }
    )


def source_inventory(raw: DataFrame, tenders: DataFrame) -> DataFrame:
    """Per source: rows with a readable deadline, linked documents, relevant rows without a deadline."""
    base = raw.groupBy("source_id").agg(
        F.count_if(instant(F.col("effective_closing_date")).isNotNull()).alias("dates_available"),
        F.sum(F.greatest(F.coalesce(F.size("documents"), F.lit(0)), F.lit(0))).alias("documents_linked"),
    )
    unknown = tenders.groupBy("source_id").agg(
        F.count_if(F.col("status") == "DEADLINE_UNKNOWN").alias("deadline_unknown_relevant")
    )
    return base.join(unknown, "source_id", "left").fillna(0, ["deadline_unknown_relevant"])


def run_totals(snapshots: DataFrame, tenders: DataFrame) -> DataFrame:
    """Totals of one run: sources by status, entities with active notices, active statewide rows."""
    s = snapshots.agg(
        F.count(F.lit(1)).alias("sources_attempted"),
        F.count_if(F.col("status") == "SUCCESS").alias("sources_successful"),
        F.count_if(F.col("status") == "PARTIAL").alias("sources_partial"),
        F.count_if(F.col("status") == "UNAVAILABLE").alias("sources_unavailable"),
    )
    live = tenders.filter(F.col("status").isin(ACTIVE))
    e = entity_notices(live).agg(F.count_distinct("entity_id").alias("active_entities"))
    w = live.agg(F.count_if(F.col("procurement_scope") == "statewide").alias("active_statewide"))
    return s.crossJoin(e).crossJoin(w)  # one row each


# Links that are portal placeholders, and links that are documents.
PLACEHOLDER_LINK = r"FrontEndViewTender|FrontEndTenderDetails"
DOCUMENT_URL = r"\.(?:pdf|xlsx?)(?:$|\?)|/showbidDocument/"
DOCUMENT_LABEL = r"\.(?:pdf|xlsx?)\b"


def group_table(spark, groups: list = rules.PRIORITY_GROUPS) -> DataFrame:
    return spark.createDataFrame(
        [(i, g, label) for i, (g, label, _, _) in enumerate(groups)], "position int, grp string, label string"
    )


def category_candidates(raw: DataFrame, groups: list = rules.PRIORITY_GROUPS) -> DataFrame:
    """Rows per priority group: an alias in the evidence or a classified group, once each.

    Needs evidence, priority_categories, is_relevant, source_id and notice_key.
    """
    gate = matches(F.col("evidence"), any_of([g[3] for g in groups]))
    alias_hits = F.when(
        gate, F.array_compact(F.array(*[F.when(matches(F.col("evidence"), p), F.lit(g)) for g, _, _, p in groups]))
    ).otherwise(F.array().cast("array<string>"))
    both = F.array_union(alias_hits, F.col("priority_categories"))
    return raw.withColumn("grp", F.explode(both)).withColumn(
        "is_confirmed", F.array_contains("priority_categories", F.col("grp"))
    )


def category_audit(
    candidates: DataFrame, tenders: DataFrame, documents: DataFrame, groups: DataFrame
) -> DataFrame:
    """Per priority group: candidates, statuses, documents and extraction states.

    ``candidates`` comes from ``category_candidates``; ``tenders`` needs status,
    priority_categories, is_current and extraction_status; ``documents`` is the long table
    of specification documents (notice_key, ordinal, url, label, doc_type, doc_status, text_method).
    """
    raw = candidates.groupBy("grp").agg(
        F.count(F.lit(1)).alias("raw_candidates"),
        F.count_if(~F.col("is_relevant")).alias("false_positives_rejected"),
        F.count_if(F.col("is_relevant") & ~F.col("is_confirmed")).alias("unconfirmed_category_candidates"),
        F.count_distinct("source_id").alias("candidate_sources"),
    )
    long = tenders.select(
        "notice_key", "ordinal", "status", "is_current", "extraction_status", F.explode("priority_categories").alias("grp")
    )
    unknown = F.col("status") == "DEADLINE_UNKNOWN"
    current = F.col("status").isin(ACTIVE) | (unknown & F.col("is_current"))
    state = F.coalesce("extraction_status", F.lit("not-processed"))
    counts = long.groupBy("grp").agg(
        F.count_if(F.col("status") == "ACTIVE_VERIFIED").alias("active_verified"),
        F.count_if(F.col("status") == "ACTIVE_LIKELY").alias("active_likely"),
        F.count_if(unknown).alias("deadline_unknown"),
        F.count_if(unknown & F.col("is_current")).alias("potentially_current_deadline_unknown"),
        F.count_if(current & (state == "complete")).alias("complete"),
        F.count_if(current & (state == "partial")).alias("partial"),
        F.count_if(current & (state == "document-unavailable")).alias("unavailable"),
        F.count_if(current & (state == "not-processed")).alias("not_processed"),
    )
    real = ~matches(F.col("url"), PLACEHOLDER_LINK) & (
        matches(F.col("url"), DOCUMENT_URL)
        | matches(F.col("label"), DOCUMENT_LABEL)
        | F.col("doc_status").isin("parsed", "scanned")
    )
    named = documents.filter(real).select(
        "notice_key", F.col("ordinal").alias("doc_ordinal"), "url", F.struct("doc_type", "doc_status", "text_method").alias("d")
    )
    last = (
        long.filter(current)
        .join(named, "notice_key")
        .groupBy("grp", "url")
        .agg(F.max_by("d", F.struct("ordinal", "doc_ordinal")).alias("d"))
        .select("grp", "d.*")
    )
    technical = F.col("doc_type").isin("technical-specification", "tender-document")
    parsed = F.col("doc_status") == "parsed"
    scan = F.coalesce(F.col("text_method") == "reviewed-scan", F.lit(False))
    docs = last.groupBy("grp").agg(
        F.count(F.lit(1)).alias("documents_found"),
        F.count_if(technical).alias("technical_documents_found"),
        F.count_if(technical & parsed & ~scan).alias("technical_documents_parsed"),
        F.count_if(scan).alias("reviewed_scans"),
        F.count_if(parsed & (F.col("doc_type") == "boq")).alias("boqs_parsed"),
    )
    out = groups
    for part in (raw, counts, docs):
        out = out.join(part, "grp", "left")
    return out.fillna(0).orderBy("position")


def write_audit(tables: dict[str, DataFrame], folder: str) -> None:
    """One JSON folder per audit table."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}")
