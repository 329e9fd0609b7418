"""Example queries on page scans: rows rendered to HTML and JSON text, scanned, and compared with the columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import listings
from ..sources.html import scan_rows
from .tables import iso_day, spread, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
PORTAL = "https://etenders.gov.in/eprocure/app"


def query_of(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return keep


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *cells), F.lit("</td></tr>\n"))


def _text(c: Column) -> Column:
    return c.cast("string")


def _pages(rows: DataFrame, by: str, html: Column, *order: str) -> DataFrame:
    """One page for each value of ``by``, its rows in order; a customer has few orders by construction."""
    parts = F.array_sort(F.collect_list(F.struct(*order, html.alias("h"))))
    body = F.array_join(F.transform(parts, lambda x: x["h"]), "")
    return spread(rows, by=by).groupBy(F.col(by).alias("page_id")).agg(F.concat(F.lit("<table>"), body, F.lit("</table>")).alias("html"))


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders moved ten years on, so that their dates are readable listing dates."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    return o.withColumn("day", F.add_months("o_orderdate", 120))


@query_of(
    "order_portal_listing",
    """
    SELECT o_custkey AS page_id, '2026_ABC_' || o_orderkey || '_1' AS tender_id, 'Order ' || o_orderkey AS title, 'REF/' || o_orderkey AS reference_number,
      o_orderpriority || '||' || o_orderstatus AS organisation, len(string_split(o_orderpriority || '||' || o_orderstatus, '||')) AS levels,
      strftime(o_orderdate + INTERVAL 10 YEAR, '%Y-%m-%d') || 'T09:30:00+05:30' AS publish_date,
      CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate + INTERVAL 10 YEAR, '%Y-%m-%d') || 'T23:59:59+05:30'
        ELSE strftime(o_orderdate + INTERVAL 10 YEAR, '%Y-%m-%d') || 'T15:00:00+05:30' END AS original_closing_date,
      CASE WHEN o_orderkey % 3 = 0 THEN 'day' ELSE 'minute' END AS date_precision,
      'https://etenders.gov.in/eprocure/app?page=FrontEndViewTender&sp=' || o_orderkey AS tender_url
    FROM orders
    """,
)
def order_portal_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Portal listing pages, a page for each customer; every fifth notice is listed twice and the first row counts."""
    o = _orders(spark, folder)
    k, day = _text(F.col("o_orderkey")), F.date_format("day", "dd-MMM-yyyy")
    links = F.concat(
        F.lit('<a href="/eprocure/app?page=FrontEndViewTender&amp;sp='), k, F.lit('&amp;session=T">[Order '), k,
        F.lit("]</a> [REF/"), k, F.lit("] [2026_ABC_"), k, F.lit("_1]"),
    )
    closing = F.when(F.col("o_orderkey") % 3 == 0, day).otherwise(F.concat(day, F.lit(" 03:00 PM")))
    chain = F.concat_ws("||", "o_orderpriority", "o_orderstatus")
    row = _row(F.lit("1"), F.concat(day, F.lit(" 09:30 AM")), closing, F.lit(""), links, chain)
    again = F.when(F.col("o_orderkey") % 5 == 0, F.replace(row, F.lit("[Order "), F.lit("[Repeat of "))).otherwise("")
    pages = _pages(o, "o_custkey", F.concat(row, again, _row(F.lit("short"))), "o_orderkey").withColumn("url", F.lit(PORTAL))
    # orders without a customer stand on no page
    out = listings.portal_listing(scan_rows(pages.filter("page_id is not null"), carry=["url"]))
    return out.select(
        "page_id", "tender_id", "title", "reference_number", "organisation", F.size("organisation_chain").cast("bigint").alias("levels"),
        "publish_date", "original_closing_date", "date_precision", "tender_url",
    )


@query_of(
    "supplier_details",
    """
    SELECT s_suppkey AS page_id, '2026_ABC_' || s_suppkey || '_1' AS d_tender_id, s_name AS d_title, CASE WHEN s_suppkey % 2 = 0 THEN 'place ' || s_nationkey END AS d_location
    FROM supplier
    """,
)
def supplier_details(spark: SparkSession, folder: str) -> DataFrame:
    """Key and value cells of detail pages; the first occurrence of a label counts."""
    s = table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    place = F.when(F.col("s_suppkey") % 2 == 0, _row(F.lit("Location"), F.concat(F.lit("place "), _text(F.col("s_nationkey"))))).otherwise("")
    html = F.concat(
        F.lit("<table>"), _row(F.lit("Tender ID"), F.concat(F.lit("2026_ABC_"), _text(F.col("s_suppkey")), F.lit("_1"))),
        _row(F.lit("Title"), F.col("s_name"), F.lit("unknown label"), F.lit("x")), place, _row(F.lit("Title"), F.lit("second")), F.lit("</table>"),
    )
    pages = s.select(F.col("s_suppkey").alias("page_id"), html.alias("html"))
    return listings.detail_fields(scan_rows(pages), listings.PORTAL_LABELS).select("page_id", "d_tender_id", "d_title", "d_location")


def _search_pages(spark: SparkSession, folder: str) -> DataFrame:
    """JSON search pages, one for each customer; every tenth holds a broken id, every tenth names no document."""
    o = _orders(spark, folder)
    k, day = _text(F.col("o_orderkey")), iso_day(F.col("day"))
    broken = F.when(F.col("o_custkey") % 10 == 0, F.lit("x")).otherwise(F.lit(""))
    doc = F.format_string(
        '{"b_bid_number":["GEM/2026/B/%s%s"],"b_id":"%s","b_category_name":["Order &amp; %s"],"bbt_title":"<b>%s</b>",'
        '"final_start_date_sort":["%sT09:30:00Z"],"final_end_date_sort":["%sT15:00:00.000Z"],"b_status":%s,"b_bid_type":"%s","b_eval_type":"1"}',
        k, broken, k, k, F.col("o_orderstatus"), day, day,
        F.when(F.col("o_orderstatus") == "F", "3").otherwise("1"),
        F.when(F.col("o_orderkey") % 3 == 0, "2").when(F.col("o_orderkey") % 3 == 1, "5").otherwise("1"),
    )
    pages = o.groupBy(F.col("o_custkey").alias("page_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", doc.alias("d")))), lambda x: x["d"]), ",").alias("docs"),
        F.count(F.lit(1)).alias("n"),
    )
    full = F.format_string('{"code":200,"status":1,"message":"ok","response":{"response":{"numFound":%d,"start":0,"docs":[%s]}}}', "n", "docs")
    none = F.lit('{"code":404,"status":0,"message":"No data found"}')
    return pages.select("page_id", F.when(F.col("page_id") % 10 == 1, none).otherwise(full).alias("json"))


@query_of(
    "order_search_records",
    """
    SELECT o_custkey AS page_id, 'GEM/2026/B/' || o_orderkey AS tender_id, 'Order & ' || o_orderkey || ' — ' || o_orderstatus AS title,
      'https://bidplus.gem.gov.in/' || CASE o_orderkey % 3 WHEN 0 THEN 'list-ra-schedules' WHEN 1 THEN 'showdirectradocumentPdf' ELSE 'showbidDocument' END || '/' || o_orderkey AS tender_url,
      strftime(o_orderdate + INTERVAL 10 YEAR, '%Y-%m-%d') || 'T09:30:00+05:30' AS publish_date,
      strftime(o_orderdate + INTERVAL 10 YEAR, '%Y-%m-%d') || 'T15:00:00+05:30' AS extended_closing_date,
      o_orderstatus = 'F' AS cancelled, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS documents
    FROM orders WHERE o_custkey % 10 > 1
    """,
)
def order_search_records(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the JSON search pages as notices."""
    _, docs, _ = listings.search_page(_search_pages(spark, folder))
    out = listings.search_records(docs)
    return out.select(
        "page_id", "tender_id", "title", "tender_url", "publish_date", "extended_closing_date", "cancelled", F.size("documents").alias("documents")
    )


@query_of(
    "order_search_pages",
    """
    SELECT o_custkey AS page_id, CASE o_custkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE count(*) END AS total,
      CASE WHEN o_custkey % 10 = 0 THEN 'response-structure' END AS reason
    FROM orders GROUP BY o_custkey
    """,
)
def order_search_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of readable and empty pages, and pages set aside whole because one id is broken."""
    totals, _, bad = listings.search_page(_search_pages(spark, folder))
    return totals.select("page_id", "total", F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select("page_id", F.lit(None).cast("bigint").alias("total"), "reason")
    )


@query_of(
    "order_notice_keys",
    """
    SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS source_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS status FROM orders
    """,
)
def order_notice_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Two sources of different columns in one table."""
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    a = o.filter("k % 2 = 0").withColumn("source_id", F.lit("a"))
    b = o.filter("k % 2 <> 0").select("k").withColumn("source_id", F.lit("b"))
    return listings.union_notices(a, b)
