"""Outbound item feed: one content fingerprint per notice, and change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import deadline_instant, instant
from ..functions.identifiers import first_present, present, printed_bid_id
from ..functions.patterns import matches
from ..functions.text import plain_text, whole_quantity
from ..functions.urls import web_reference
from ..plans.lineage import computed_once, cut
from .ranking import chunked_row_number, one_distinct, top_per_group

# A clause that states one direct quantity, and the list limits.
DIRECT_QUANTITY = (
    r"(?:^|/)\s*(?:total\s+)?(?:quantity|qty)\s*[:=]?\s*\d+\s*(?:nos?\.?|units?|sets?|pieces?)?\s*\.?$"
)
ITEM_LIMIT, LIST_LIMIT = 100, 100
TITLE_LABEL = "Tender title; review equipment lines"

REVISIONS = "array<struct<title:string,url:string,published_date:string,revised_closing_date:string>>"

ITEM_COLUMNS = [
    "notice_key", "tier", "item_ordinal", "item_id", "equipment", "quantity", "quantity_text", "category",
    "source_url", "source_label", "source_page", "source_sheet", "source_row",
]


ITEM = (
    "struct<item_id:string,equipment:string,quantity:int,quantity_text:string,category:string,source_url:string,"
    "source_label:string,source_page:int,source_sheet:string,source_row:int>"
)


def _item(item_id, equipment, quantity, quantity_text, category, url, label, page, sheet, row) -> Column:
    values = (item_id, equipment, quantity, quantity_text, category, url, label, page, sheet, row)
    names = [c for c in ITEM_COLUMNS if c not in ("notice_key", "tier", "item_ordinal")]
    return F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)]).cast(ITEM)


def _ladder(notices: DataFrame, quantities: DataFrame, origin: str) -> DataFrame:
    """Notices with a usable address, their ``tier``, ``item_count`` and ``__own``: the items of tiers 1 and 3.

    Price-schedule rows are only counted here, map-side.
    """
    base = F.lit(origin)
    none = F.lit(None).cast("string")
    url = F.coalesce(web_reference(F.col("tender_url"), base), web_reference(F.col("source_url"), base))
    own = computed_once(notices, {"__url": url}).filter(F.col("__url").isNotNull())
    declared = F.filter(
        F.transform(
            F.coalesce("equipment_items", F.array()),
            lambda e, i: _item(
                F.coalesce(plain_text(e["id"]), F.concat(F.lit("item-"), i + 1)),
                plain_text(e["name"]),
                whole_quantity(e["quantity_text"]),
                plain_text(e["quantity_text"]),
                plain_text(e["category"]),
                web_reference(e["source_url"], base),
                plain_text(e["source_label"]),
                e["source_page"],
                plain_text(e["source_sheet"]),
                e["source_row"],
            ),
        ),
        lambda x: x["equipment"].isNotNull(),
    )
    n = whole_quantity(F.col("quantity"))
    is_direct = matches(F.col("requirement"), DIRECT_QUANTITY)
    # one pass over the clauses: the schedule rows are counted and the direct quantities settled, both map-side
    facts = (
        computed_once(quantities, {"__in": in_schedule(), "__direct": F.coalesce(is_direct, F.lit(False))})
        .filter("__in or __direct")
        .groupBy("notice_key")
        .agg(
            F.count(F.when(F.col("__in"), 1)).alias("__rows"),
            one_distinct(F.when(F.col("__direct"), n)).alias("__q"),
            F.min_by(
                F.struct("doc_url", "label", "page"), F.when(F.col("__direct") & n.isNotNull(), F.col("ordinal"))
            ).alias("__evidence"),
        )
    )
    work = (
        own.withColumn("__declared", declared)
        .join(facts, "notice_key", "left")
        .withColumn("__single", F.when(F.coalesce(F.size("equipment_types"), F.lit(0)) <= 1, F.col("__q")))
        .withColumn("__proof", F.when(F.col("__single").isNotNull(), F.col("__evidence")))
    )
    title_item = _item(
        F.lit("unstructured-title"),
        plain_text(F.col("title")),
        F.col("__single"),
        none,
        none,
        F.coalesce(web_reference(F.col("__proof.doc_url"), base), F.col("__url")),
        F.coalesce(plain_text(F.col("__proof.label")), F.lit(TITLE_LABEL)),
        F.col("__proof.page"),
        none,
        F.lit(None),
    )
    tier = F.when(F.size("__declared") > 0, 1).when(F.col("__rows") > 0, 2).otherwise(3)
    count = F.when(F.size("__declared") > 0, F.size("__declared")).when(F.col("__rows") > 0, F.col("__rows")).otherwise(1)
    items = F.when(F.size("__declared") > 0, F.col("__declared")).when(F.coalesce("__rows", F.lit(0)) == 0, F.array(title_item))
    return work.withColumns({"tier": tier, "item_count": count.cast("bigint"), "__own": items}).drop(
        "__url", "__declared", "__rows", "__q", "__evidence", "__single", "__proof"
    )


def in_schedule() -> Column:
    """Quantity clauses that are rows of a price schedule."""
    in_sheet = (F.col("row") > 0) & present(F.col("sheet")).isNotNull()
    return F.coalesce((F.col("doc_type") == "boq") & in_sheet, F.lit(False))


def _schedule_item(origin: str) -> Column:
    """The item of a price-schedule row numbered ``__n`` in its notice."""
    return _item(
        F.concat_ws("-", F.lit("boq"), F.col("sheet"), F.col("row").cast("string"), (F.col("__n") - 1).cast("string")),
        plain_text(F.col("requirement")),
        whole_quantity(F.col("quantity")),
        plain_text(F.col("quantity")),
        F.lit(None).cast("string"),
        web_reference(F.col("doc_url"), F.lit(origin)),
        plain_text(F.col("label")),
        F.col("page"),
        plain_text(F.col("sheet")),
        F.col("row"),
    )


def with_items(notices: DataFrame, quantities: DataFrame, origin: str, item_limit: int = ITEM_LIMIT) -> DataFrame:
    """Notices with a usable address, their ``tier``, ``item_count`` and ``items``.

    Declared items (1), else price-schedule rows (2), else one title item (3).  ``notices`` needs notice_key, title,
    tender_url, source_url, equipment_items and equipment_types (array); ``quantities`` is the long table of current
    quantity clauses (notice_key, ordinal, requirement, quantity, doc_url, doc_type, label, page, sheet, row).

    ``item_count`` covers all items.  ``items`` is whole or, where there are more than ``item_limit``, null: those are
    read as rows with ``feed_items``.
    """
    # a notice with more rows than the limit gets no list, so its rows past the limit need not travel to be refused
    rows = top_per_group(quantities.filter(in_schedule()), ["notice_key"], [F.asc("ordinal")], item_limit, "__n")
    schedule = (
        rows.select("notice_key", "__n", _schedule_item(origin).alias("__item"))
        .groupBy("notice_key")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__item"))), lambda x: x["__item"]).alias("__schedule"))
    )
    items = F.when(F.col("item_count") <= item_limit, F.when(F.col("tier") == 2, F.col("__schedule")).otherwise(F.col("__own")))
    return (
        _ladder(notices, quantities, origin)
        .join(schedule, "notice_key", "left")
        .withColumn("items", items)
        .drop("__own", "__schedule")
    )


def feed_items(notices: DataFrame, quantities: DataFrame, origin: str) -> DataFrame:
    """All item rows (``ITEM_COLUMNS``) of the notices ``with_items`` describes, whatever their number.

    Schedule rows are ordered by ranges and numbered from the ranges' counts, so a long schedule is in no single task.
    """
    work = _ladder(notices, quantities, origin)
    own = work.filter("tier <> 2").select("notice_key", "tier", F.posexplode("__own").alias("item_ordinal", "item"))
    # the ranges are drawn from a sample, so they are written once
    ranges = cut(
        quantities.filter(in_schedule())
        .repartitionByRange("notice_key", "ordinal")
        .withColumn("__range", F.spark_partition_id())
    )
    numbered = chunked_row_number(ranges, ["notice_key"], [F.asc("ordinal")], F.col("__range"), "__n")
    scheduled = numbered.join(work.filter("tier = 2").select("notice_key", "tier"), "notice_key").select(
        "notice_key", "tier", (F.col("__n") - 1).alias("item_ordinal"), _schedule_item(origin).alias("item")
    )
    rows = own.unionByName(scheduled)
    return rows.select("notice_key", "tier", F.col("item_ordinal").cast("bigint"), "item.*")


def size_guard(rows: DataFrame, limit: int = ITEM_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by ``item_count``: more items than ``limit`` need manual entry."""
    return rows.filter(F.col("item_count") <= limit), rows.filter(F.col("item_count") > limit).drop("items")


def iso(ts: Column) -> Column:
    """UTC text with milliseconds, independent of the session zone."""
    ms = F.floor(F.unix_micros(ts) / 1000)
    local = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(secs=(ms / 1000).cast("decimal(18,6)"))
    return F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def last_by_url(links: Column) -> Column:
    """Links distinct by address: the last label, at the place of the first."""
    urls = F.array_distinct(F.transform(links, lambda d: d["url"]))
    return F.transform(urls, lambda u: F.element_at(F.filter(links, lambda d: d["url"] == u), -1))


def feed_notices(
    notices: DataFrame, quantities: DataFrame, origin: str, item_limit: int = ITEM_LIMIT, list_limit: int = LIST_LIMIT
) -> tuple[DataFrame, DataFrame]:
    """(outbound rows with a content fingerprint, rejected notices with more than ``item_limit`` items).

    Observation times are outside the fingerprint, so a repeated check changes nothing.  Documents are the notice's and
    its specification's (``specification_documents``: label, url, published_date), one for each address; ``truncated``
    marks rows with more than ``list_limit`` entries in one of their lists.  Rejected rows keep the columns of their
    notice with ``tier`` and ``item_count``; ``feed_items`` of them and the same ``quantities`` gives all their items.
    """
    base = F.lit(origin)
    accepted, rejected = size_guard(with_items(notices, quantities, origin, item_limit), item_limit)
    pair = "array<struct<label:string,url:string>>"

    def links(name: str, label: str, default: str) -> Column:
        if name not in notices.columns:
            return F.array().cast(pair)
        mapped = F.filter(
            F.transform(
                name,
                lambda d: F.struct(
                    F.coalesce(plain_text(d[label]), F.lit(default)).alias("label"),
                    web_reference(d["url"], base).alias("url"),
                ),
            ),
            lambda d: d["url"].isNotNull(),
        )
        return F.coalesce(mapped, F.array().cast(pair))

    def col(name: str) -> Column:
        return F.col(name) if name in notices.columns else F.lit(None).cast("string")

    revisions = (
        F.transform(
            "corrigenda",
            lambda c: F.struct(
                plain_text(F.coalesce(c["title"], c["type"])).alias("title"),
                web_reference(c["url"], base).alias("url"),
                iso(instant(c["published_date"])).alias("published_date"),
                iso(deadline_instant(c["revised_closing_date"])).alias("revised_closing_date"),
            ),
        )
        if "corrigenda" in notices.columns
        else F.array().cast(REVISIONS)
    )
    content = {
        "external_id": F.col("id"),
        "source_url": F.coalesce(web_reference(col("tender_url"), base), web_reference(col("source_url"), base)),
        "source_name": F.coalesce(plain_text(col("source_name")), F.col("source_id")),
        "number": plain_text(F.coalesce(col("reference_number"), col("tender_id"))),
        "bid_number": printed_bid_id(col("tender_id"), col("reference_number"), F.col("title")),
        "title": plain_text(F.col("title")),
        "institution": plain_text(F.coalesce(col("institution_name"), col("buyer"), col("organisation"))),
        "state": plain_text(col("region")),
        "category": plain_text(F.array_join("categories", ", ")) if "categories" in notices.columns else F.lit(None).cast("string"),
        "description": plain_text(col("description"), 10_000),
        "publication_date": iso(instant(col("publish_date"))),
        "deadline": iso(deadline_instant(col("effective_closing_date"))),
        "documents": last_by_url(
            F.concat(links("documents", "label", "Source document"), links("specification_documents", "label", "Source document"))
        ),
        "revisions": F.coalesce(revisions, F.array().cast(REVISIONS)),
        "references": links("source_references", "source_name", "Original source"),
    }
    dated = (
        F.transform("specification_documents", lambda d: iso(instant(d["published_date"])))
        if "specification_documents" in notices.columns
        else F.array().cast("array<string>")
    )
    rows = accepted.select(
        "notice_key",
        *[c.alias(n) for n, c in content.items()],
        "items",
        iso(F.coalesce(instant(col("fetched_at")), instant(col("checked_at")))).alias("discovered_at"),
        dated.alias("__dated"),
    )
    lists = ("documents", "revisions", "references")
    published = F.concat(F.transform("revisions", lambda r: r["published_date"]), F.coalesce("__dated", F.array()))
    rows = rows.withColumns(
        {
            "source_updated_at": F.array_max(published),
            "truncated": F.greatest(*[F.size(c) for c in lists]) > list_limit,
        }
    ).withColumns({c: F.slice(c, 1, list_limit) for c in lists})
    return rows.drop("__dated").withColumn("fingerprint", fingerprint([*sorted(content), "items"])), rejected


def fingerprint(columns: list[str]) -> Column:
    """sha256 of the canonical JSON of the given columns, in the given order."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def detect_changes(current: DataFrame, delivered: DataFrame, key: str = "external_id") -> DataFrame:
    """new / same / changed / removed per id: one full join on the id and two fingerprints."""
    a = current.select(F.col(key), F.col("fingerprint").alias("current_fingerprint"))
    b = delivered.select(F.col(key), F.col("fingerprint").alias("delivered_fingerprint"))
    change = (
        F.when(F.col("delivered_fingerprint").isNull(), "new")
        .when(F.col("current_fingerprint").isNull(), "removed")
        .when(F.col("current_fingerprint") == F.col("delivered_fingerprint"), "same")
        .otherwise("changed")
    )
    return a.join(b, key, "full").withColumn("change", change)


def external_key(tender_id: Column, record_id: Column) -> Column:
    return first_present(tender_id, record_id)
