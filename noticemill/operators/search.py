"""Filtering, ordering, facets and the view-level columns of the result list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import days_until, deadline_instant, instant
from ..functions.identifiers import present, printed_bid_id
from ..functions.patterns import matches
from ..functions.urls import host, parameter, path, public_link
from ..sources import medical_rules as rules
from .status import ACTIVE, refresh_elapsed


@dataclass(frozen=True)
class Filters:
    query: str = ""
    region: str = ""
    institution: str = ""
    scope: str = ""
    status: str = "active"
    category: str = ""
    priority_equipment: str = ""
    brand: str = ""
    explicit: bool = False
    source: str = ""
    closing: int | None = None
    sort: str = "closing"
    prioritize: bool = True
    view: str = "all"


def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def active(status: Column) -> Column:
    return status.isin(ACTIVE)


def search_text(df: DataFrame) -> Column:
    """Lower case text the keyword search runs on; store it when a table is searched often."""
    parts: list[Column] = []
    for name in ("title", "description", "institution_name"):
        if _has(df, name):
            parts.append(present(F.col(name)))
    if _has(df, "consignees"):
        parts.append(F.array_join(F.transform("consignees", lambda c: c["name"]), " "))
    for name in ("organisation", "department", "buyer", "location", "tender_id", "reference_number"):
        if _has(df, name):
            parts.append(present(F.col(name)))
    if _has(df, "requirements"):
        parts.append(
            F.array_join(
                F.transform(
                    "requirements",
                    lambda r: F.concat_ws(": ", r["field"], F.coalesce(present(r["value"]), r["requirement"])),
                ),
                " ",
            )
        )
    if _has(df, "source_name"):
        parts.append(present(F.col("source_name")))
    if _has(df, "categories"):
        parts.append(F.translate(F.array_join("categories", " "), "_", " "))
    if _has(df, "matched_keywords"):
        parts.append(F.array_join("matched_keywords", " "))
    if _has(df, "brand_matches"):
        parts.append(
            F.array_join(
                F.transform("brand_matches", lambda m: F.concat_ws(" ", m["brand"], F.array_join(m["terms"], " "))), " "
            )
        )
    return F.lower(F.concat_ws(" ", *parts))


def keyword_filter(text: Column, query: str) -> Column:
    """Every white-space term is a substring of the text."""
    ok = F.lit(True)
    for term in query.strip().lower().split():
        ok = ok & F.contains(text, F.lit(term))
    return ok


def contributes_to(df: DataFrame, source: str) -> Column:
    """The row's own source or any provenance source."""
    own = F.col("source_id") == source
    if not _has(df, "source_references"):
        return own
    return own | F.coalesce(F.exists("source_references", lambda r: r["source_id"] == source), F.lit(False))


def filter_tenders(df: DataFrame, f: Filters, now: Column) -> DataFrame:
    """Conjunction of the chosen facets; unset facets add nothing to the plan."""
    ok: list[Column] = []
    if f.query.strip():
        text = F.col("search_text") if _has(df, "search_text") else search_text(df)
        ok.append(keyword_filter(text, f.query))
    if f.region:
        ok.append(F.col("region") == f.region)
    if f.institution:
        hit = F.col("institution_id") == f.institution
        if _has(df, "consignees"):
            hit = hit | F.coalesce(
                F.exists("consignees", lambda c: c["institution_id"] == f.institution), F.lit(False)
            )
        ok.append(hit)
    if f.scope:
        ok.append(F.col("procurement_scope") == f.scope)
    if f.status == "active":
        ok.append(active(F.col("status")))
    elif f.status != "all":
        ok.append(F.col("status") == f.status)
    if f.category:
        ok.append(F.array_contains("categories", f.category))
    if f.priority_equipment:
        ok.append(F.array_contains("priority_categories", f.priority_equipment))
    if f.brand or f.explicit:

        def wanted(m: Column) -> Column:
            hit = (m["brand"] == f.brand) if f.brand else F.lit(True)
            return hit & (m["match_type"] != "portfolio") if f.explicit else hit

        ok.append(F.exists("brand_matches", wanted))
    if f.source:
        ok.append(contributes_to(df, f.source))
    if f.closing is not None:
        ok.append(days_until(F.col("effective_closing_date"), now).between(0, f.closing))
    if f.view == "gem":
        ok.append(is_bid_portal(df))
    elif f.view == "manual":
        ok.append(needs_manual_portal(df))
    for condition in ok:
        df = df.filter(condition)
    return df


def sort_columns(df: DataFrame, f: Filters, priority_enabled: Column) -> list[Column]:
    """Sort keys of the result list; the input ordinal settles ties."""
    deadline = F.asc_nulls_last(deadline_instant(F.col("effective_closing_date")))
    listed = F.size(F.coalesce("priority_categories", F.array().cast("array<string>"))) > 0
    complete = F.col("extraction_status") == "complete" if _has(df, "extraction_status") else F.lit(False)
    keys: list[Column] = []
    if f.sort == "closing":

        def only(c: Column) -> Column:
            return F.when(priority_enabled, F.coalesce(c, F.lit(False)).cast("int")).otherwise(0)

        keys += [
            F.asc_nulls_last(
                F.when(priority_enabled, deadline_instant(F.col("effective_closing_date"))).otherwise(F.lit(None))
            ),
            F.desc(only(listed)),
            F.desc(only(F.col("status") == "ACTIVE_VERIFIED")),
            F.desc(only(complete)),
        ]
    if f.prioritize:
        keys.append(F.desc((F.size("brand_matches") > 0).cast("int")))
    if f.sort == "newest":
        keys.append(F.desc(F.coalesce(F.unix_micros(instant(F.col("publish_date"))), F.lit(0))))
    elif f.sort == "relevance":
        keys.append(F.desc("confidence"))
    else:
        keys.append(deadline)
    return [*keys, F.asc("ordinal")]


def filter_and_sort(df: DataFrame, f: Filters, now: Column) -> DataFrame:
    """Refresh statuses, filter and order. Priority order applies when any unfiltered row has a group."""
    refreshed = refresh_elapsed(df, now)
    flag = df.agg(
        F.coalesce(F.max(F.size(F.coalesce("priority_categories", F.array().cast("array<string>"))) > 0), F.lit(False)).alias(
            "__priority"
        )
    )
    rows = filter_tenders(refreshed, f, now).crossJoin(flag)  # one-row side
    return rows.orderBy(*sort_columns(rows, f, F.col("__priority"))).drop("__priority")


UNKNOWN_QUEUE = Filters(status="DEADLINE_UNKNOWN", sort="newest", prioritize=False)


def facet_counts(df: DataFrame, facets: dict[str, Column], measures: dict[str, Column]) -> DataFrame:
    """(facet, value, counts...): all facets in one pass over the rows.

    Array facets count a row once per element; the shuffle carries one partial count
    per facet value and task.
    """

    def entries(name: str, c: Column) -> Column:
        values = c if dict(df.select(c.alias("v")).dtypes)["v"].startswith("array") else F.array(c)
        return F.transform(
            F.array_distinct(values), lambda v: F.struct(F.lit(name).alias("facet"), v.cast("string").alias("value"))
        )

    every = F.flatten(F.array(*[F.coalesce(entries(n, c), F.array().cast("array<struct<facet:string,value:string>>")) for n, c in facets.items()]))
    flags = df.select(every.alias("e"), *[m.alias(n) for n, m in measures.items()])
    return (
        flags.select(F.explode("e").alias("e"), *measures)
        .groupBy("e.facet", "e.value")
        .agg(*[F.count_if(n).alias(n) for n in measures])
    )


def headline(df: DataFrame, entities: DataFrame, now: Column) -> DataFrame:
    """Headline statistics in one row."""
    days = days_until(F.col("effective_closing_date"), now)
    rows = df.agg(
        F.count_if(active(F.col("status"))).alias("active"),
        F.count_if(F.col("status") == "ACTIVE_VERIFIED").alias("verified"),
        F.count_if(F.col("status") == "ACTIVE_LIKELY").alias("likely"),
        F.count_if(active(F.col("status")) & days.between(0, 7)).alias("closing_in_7_days"),
        F.count_if(F.col("status") == "DEADLINE_UNKNOWN").alias("deadline_unknown"),
    )
    dims = entities.agg(
        F.count(F.lit(1)).alias("entities"), F.count_distinct("region").alias("regions")
    )
    return dims.crossJoin(rows)  # one row each


def statewide(df: DataFrame) -> DataFrame:
    return df.filter((F.col("procurement_scope") == "statewide") & present(F.col("institution_id")).isNull())


# --- links ---------------------------------------------------------------------

# The bid portal host and the portal pages that need manual steps.
BID_PORTAL = "gem.gov.in"
MANUAL_PATH = r"\/(?:eprocure|nicgep)\/app$"
MANUAL_PAGE = r"FrontEndViewTender|FrontEndTenderDetails"
LINKS = "array<struct<label:string,url:string>>"


def _array(df: DataFrame, name: str, kind: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(kind)) if _has(df, name) else F.array().cast(kind)


def is_bid_portal(df: DataFrame) -> Column:
    refs = F.transform(
        _array(df, "source_references", "array<struct<source_id:string,source_name:string,url:string>>"), lambda r: r["url"]
    )
    urls = F.concat(F.array(F.col("tender_url"), F.col("source_url")), refs)
    on_portal = F.exists(
        urls, lambda u: F.coalesce((host(u) == BID_PORTAL) | F.endswith(host(u), F.lit("." + BID_PORTAL)), F.lit(False))
    )
    return printed_bid_id(F.col("tender_id"), F.col("reference_number"), F.col("title")).isNotNull() | on_portal


def needs_manual_portal(df: DataFrame) -> Column:
    urls = F.concat(
        F.array(F.col("tender_url"), F.col("source_url")), F.transform(_array(df, "documents", LINKS), lambda d: d["url"])
    )
    return F.exists(
        urls,
        lambda u: F.coalesce(
            public_link(u).isNotNull() & matches(path(u), MANUAL_PATH, "") & matches(parameter(u, "page"), MANUAL_PAGE, ""),
            F.lit(False),
        ),
    )


def document_inventory(df: DataFrame, reviewed_links: DataFrame | None = None, key: str = "notice_key") -> DataFrame:
    """(key, links): official links in priority order; the first label of a URL wins.

    ``reviewed_links`` (bid, url) adds directly known document links.
    """
    bid = printed_bid_id(F.col("tender_id"), F.col("reference_number"), F.col("title"))
    work = df.withColumns({"__bid": bid, "__manual": needs_manual_portal(df)})
    if reviewed_links is not None:
        work = work.join(
            reviewed_links.select(F.col("bid").alias("__bid"), F.col("url").alias("__known")), "__bid", "left"
        )
    else:
        work = work.withColumn("__known", F.lit(None).cast("string"))

    def link(label: Column, url: Column) -> Column:
        return F.struct(label.alias("label"), url.alias("url"))

    refs = F.filter(
        _array(df, "source_references", "array<struct<source_id:string,source_name:string,url:string>>"),
        lambda r: F.coalesce(F.endswith(host(r["url"]), F.lit("." + BID_PORTAL)), F.lit(False)),
    )
    main = F.when(F.col("__manual"), "Open official tender & documents").otherwise("Official notice")
    amendments = _array(
        df,
        "corrigenda",
        "array<struct<title:string,type:string,published_date:string,revised_closing_date:string,url:string>>",
    )
    every = F.concat(
        F.array(link(F.lit("Open GeM bid"), F.col("__known"))),
        F.transform(refs, lambda r: link(F.lit("Official GeM link"), r["url"])),
        F.array(link(main, F.coalesce(public_link(F.col("tender_url")), F.col("source_url")))),
        F.transform(_array(df, "documents", LINKS), lambda d: link(d["label"], d["url"])),
        F.transform(_array(df, "spec_documents", LINKS), lambda d: link(d["label"], d["url"])),
        F.transform(amendments, lambda c: link(F.coalesce(present(c["title"]), F.lit("Official corrigendum")), c["url"])),
    )
    public = F.filter(
        F.transform(every, lambda x: link(x["label"], public_link(x["url"]))), lambda x: x["url"].isNotNull()
    )
    work = work.select(key, public.alias("__links"))
    urls = F.transform("__links", lambda x: x["url"])
    first = F.filter("__links", lambda x, i: F.array_position(urls, x["url"]) == i + 1)
    return work.select(key, first.alias("links"))


def section_view(requirements: DataFrame, key: str = "notice_key") -> DataFrame:
    """(key, section, label, position, clauses) in display order."""
    spark = requirements.sparkSession
    order = spark.createDataFrame(
        [(s, label, i) for i, (s, label) in enumerate(rules.SECTIONS)], "section string, label string, position int"
    )
    item = F.struct("ordinal", "field", "requirement", "value", "quantity", "mandatory")
    return (
        requirements.groupBy(key, "section")
        .agg(F.array_sort(F.collect_list(item)).alias("clauses"))
        .join(order, "section")
        .orderBy(key, "position")
    )


def write_result(df: DataFrame, path_: str) -> None:
    """The result list as JSON lines, one object per record."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path_)
