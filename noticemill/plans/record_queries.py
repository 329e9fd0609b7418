"""Example queries on record tables: status, merge, selection, search, audits, snapshots and feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import host, path
from ..operators import feed, quality, search, selection, snapshots, status
from ..operators.components import connected_components
from ..operators.dedupe import deduplicate, link_retenders
from ..operators.ranking import one_distinct
from .lineage import cut
from .tables import clock, iso_day, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query_of(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return keep


NOW = "1998-09-15 12:00:00"


def order_notices(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as notices: closing day = order day + 60, priority as verification and precision."""
    o = table(spark, folder, "orders")
    day = F.col("o_orderdate")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("notice_key"),
        k.alias("ordinal"),
        F.col("o_custkey").alias("customer"),
        F.col("o_orderpriority").alias("grp"),
        F.col("o_totalprice").alias("price"),
        iso_day(day).alias("publish_date"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(
            F.concat(iso_day(F.date_add(day, 60)), F.when(k % 2 == 0, F.lit("T15:00:00+05:30")).otherwise(F.lit("")))
        ).alias("original_closing_date"),
        F.lit(None).cast("string").alias("extended_closing_date"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "detail").otherwise("listing").alias("verification"),
        F.when(k % 3 == 0, "day").otherwise("minute").alias("date_precision"),
        (F.col("o_orderstatus") == "P").alias("cancelled"),
        F.lit("1998-09-15T06:00:00Z").alias("fetched_at"),
    )


def order_amendments(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as amendments: returned parts cancel, accepted parts revise the closing day."""
    li = table(spark, folder, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate"
        )
    return li.select(
        F.col("l_orderkey").alias("notice_key"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ordinal"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7), "Notice of cancellation").otherwise("Corrigendum").alias("title"),
        F.lit(None).cast("string").alias("type"),
        iso_day(F.col("l_shipdate")).alias("published_date"),
        F.when(F.col("l_returnflag") == "A", iso_day(F.date_add("l_shipdate", 45)))
        .when(F.col("l_returnflag") == "N", "to be announced").alias("revised_closing_date"),
    )


_STATUS_CTE = """
    o AS (SELECT o_orderkey AS k, o_custkey, o_orderpriority, o_totalprice, o_orderdate,
            CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate + INTERVAL 60 DAY, '%Y-%m-%d') ||
              CASE WHEN o_orderkey % 2 = 0 THEN 'T15:00:00+05:30' ELSE '' END END AS original,
            o_orderstatus = 'P' AS cancelled, o_orderpriority = '1-URGENT' AS detail, o_orderkey % 3 = 0 AS by_day FROM orders),
    a AS (SELECT l_orderkey AS k,
            arg_max(strftime(l_shipdate + INTERVAL 45 DAY, '%Y-%m-%d'),
              {'a': l_shipdate, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey}) FILTER (WHERE l_returnflag = 'A') AS revised,
            bool_or(l_returnflag = 'R' AND l_linenumber = 7) AS ends FROM lineitem GROUP BY 1),
    e AS (SELECT o.*, coalesce(a.revised, o.original) AS effective, coalesce(a.ends, false) OR cancelled AS ended
          FROM o LEFT JOIN a ON a.k = o.k),
    i AS (SELECT *, CASE WHEN length(effective) = 10
              THEN effective::TIMESTAMP + INTERVAL 24 HOUR - INTERVAL 330 MINUTE - INTERVAL 1 MILLISECOND
            ELSE left(effective, 10)::TIMESTAMP + INTERVAL 15 HOUR - INTERVAL 330 MINUTE END AS deadline FROM e),
    s AS (SELECT *, CASE WHEN ended THEN 'CANCELLED' WHEN effective IS NULL THEN 'DEADLINE_UNKNOWN'
            WHEN deadline < TIMESTAMP '1998-09-15 12:00:00' THEN 'EXPIRED'
            WHEN detail AND NOT by_day AND length(effective) > 10 THEN 'ACTIVE_VERIFIED' ELSE 'ACTIVE_LIKELY' END AS status FROM i)
"""


def resolved_orders(spark: SparkSession, folder: str) -> DataFrame:
    return status.resolve_status(order_notices(spark, folder), clock(NOW), order_amendments(spark, folder))


@query_of("order_status", f"WITH {_STATUS_CTE} SELECT k AS notice_key, status, effective AS effective_closing_date FROM s")
def order_status(spark: SparkSession, folder: str) -> DataFrame:
    return resolved_orders(spark, folder).select("notice_key", "status", "effective_closing_date")


@query_of(
    "order_status_summary",
    f"""WITH {_STATUS_CTE} SELECT o_orderpriority AS grp, count(*) AS notices,
        count(*) FILTER (WHERE status = 'ACTIVE_VERIFIED') AS active_verified,
        count(*) FILTER (WHERE status = 'ACTIVE_LIKELY') AS active_likely,
        count(*) FILTER (WHERE status = 'DEADLINE_UNKNOWN') AS deadline_unknown,
        count(*) FILTER (WHERE status = 'EXPIRED') AS expired,
        count(*) FILTER (WHERE status = 'CANCELLED') AS cancelled FROM s GROUP BY 1""",
)
def order_status_summary(spark: SparkSession, folder: str) -> DataFrame:
    return resolved_orders(spark, folder).groupBy("grp").agg(
        F.count(F.lit(1)).alias("notices"), *quality.status_counts()
    )


@query_of(
    "order_status_refreshed",
    f"""WITH {_STATUS_CTE} SELECT k AS notice_key,
        CASE WHEN status IN ('ACTIVE_VERIFIED', 'ACTIVE_LIKELY') AND deadline < TIMESTAMP '1998-10-01 00:00:00' THEN 'EXPIRED'
             WHEN status = 'ACTIVE_VERIFIED' THEN 'ACTIVE_LIKELY' ELSE status END AS status FROM s""",
)
def order_status_refreshed(spark: SparkSession, folder: str) -> DataFrame:
    """Read half a month later: elapsed rows expire, verified rows downgrade."""
    later = status.refresh_elapsed(resolved_orders(spark, folder), clock("1998-10-01 00:00:00"))
    return later.select("notice_key", "status")


@query_of(
    "order_latest_amendment",
    """
    SELECT l_orderkey AS notice_key, strftime(max(l_shipdate), '%Y-%m-%d') AS published_date, count(*) AS amendments,
      arg_max(CASE WHEN l_returnflag = 'A' THEN strftime(l_shipdate + INTERVAL 45 DAY, '%Y-%m-%d')
                   WHEN l_returnflag = 'N' THEN 'to be announced' END || '',
        {'a': l_shipdate, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey}) FILTER (WHERE l_returnflag <> 'R') AS last_revision
    FROM lineitem GROUP BY 1
    """,
)
def order_latest_amendment(spark: SparkSession, folder: str) -> DataFrame:
    a = order_amendments(spark, folder)
    newest = status.latest_amendment(a).select("notice_key", "published_date")
    counts = a.groupBy("notice_key").agg(F.count(F.lit(1)).alias("amendments"))
    revised = status.latest_amendment(a.filter("revised_closing_date is not null")).select(
        "notice_key", F.col("revised_closing_date").alias("last_revision")
    )
    return newest.join(counts, "notice_key").join(revised, "notice_key", "left")


@query_of(
    "order_extensions",
    """
    WITH n AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT l_orderkey AS notice_key, arg_max(CASE WHEN l_returnflag = 'A' THEN strftime(l_shipdate + INTERVAL 45 DAY, '%Y-%m-%d')
        ELSE 'to be announced' END, {'a': l_shipdate, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey}) AS extended_closing_date
    FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1
    """,
)
def order_extensions(spark: SparkSession, folder: str) -> DataFrame:
    return status.running_extension(order_amendments(spark, folder))


# --- merge -------------------------------------------------------------------------


def document_notices(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as mirrored notices: the same text is the same notice."""
    d = table(spark, folder, "documents")
    return d.select(
        F.col("doc_id").alias("notice_key"),
        F.col("doc_id").alias("ordinal"),
        F.sha2("text", 256).alias("id"),
        F.sha2("text", 256).alias("title"),
        F.lit(None).cast("string").alias("tender_id"),
        F.col("source").alias("source_id"),
        F.col("lang").alias("source_name"),
        F.lit("ACTIVE_LIKELY").alias("status"),
        F.lit("listing").alias("verification"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("note "), F.col("doc_id").cast("string"))).alias("description"),
        F.lit("2026-01-01T00:00:00Z").alias("fetched_at"),
    )


@query_of(
    "document_mirrors",
    """
    WITH g AS (SELECT sha256(text) AS id, doc_id, source, lang FROM documents)
    SELECT coalesce(min(doc_id) FILTER (WHERE doc_id % 3 = 0), min(doc_id)) AS survivor, id, count(*) AS member_count,
      count(DISTINCT source || '/' || lang) AS n_references,
      'note ' || min(doc_id) FILTER (WHERE doc_id % 3 = 0) AS description
    FROM g GROUP BY id
    """,
)
def document_mirrors(spark: SparkSession, folder: str) -> DataFrame:
    merged = deduplicate(document_notices(spark, folder), clock("2026-01-01 12:00:00"))
    refs = merged.references.groupBy("notice_key").agg(F.count(F.lit(1)).alias("n_references"))
    return merged.survivors.join(refs, "notice_key").select(
        F.col("notice_key").alias("survivor"), "id", "member_count", "n_references", "description"
    )


@query_of(
    "page_mirrors",
    r"""
    WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://(?:m\.|blog\.)?([^/?#]*)', 1)) ||
                regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '(?:/|\.html)$', '') AS identity FROM pages)
    SELECT identity, count(*) AS members, max(page_id) AS survivor FROM p GROUP BY identity
    """,
)
def page_mirrors(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as observations of one address; the newest observation survives."""
    p = table(spark, folder, "pages").select("page_id", "url")
    bare_host = F.regexp_replace(host(F.col("url")), r"^(?:m\.|blog\.)", "")
    identity = F.concat(bare_host, F.regexp_replace(path(F.col("url")), r"(?:/|\.html)$", ""))
    seen = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id"))
    notices = p.select(
        F.col("page_id").alias("notice_key"), F.col("page_id").alias("ordinal"), identity.alias("tender_id"),
        F.sha2(identity, 256).alias("id"), identity.alias("title"), F.lit("web").alias("source_id"),
        F.lit("ACTIVE_LIKELY").alias("status"), F.lit("listing").alias("verification"),
        F.concat(F.date_format(F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(secs=F.unix_seconds(seen).cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("fetched_at"),
    )
    merged = deduplicate(notices, clock("2026-01-01 12:00:00"))
    return merged.survivors.select(
        F.col("tender_id").alias("identity"), F.col("member_count").alias("members"), F.col("notice_key").alias("survivor")
    )


def _component_rounds(rounds: int) -> str:
    """Label rounds in plain SQL; the graph of parts and orders closes in a handful of them."""
    out = ["e AS (SELECT DISTINCT l_partkey AS p, l_orderkey AS o FROM lineitem), l0 AS (SELECT DISTINCT p, p AS c FROM e)"]
    for r in range(rounds):
        out.append(f"k{r} AS (SELECT o, min(c) AS c FROM e JOIN l{r} USING (p) GROUP BY o)")
        out.append(f"l{r + 1} AS (SELECT p, min(c) AS c FROM e JOIN k{r} USING (o) GROUP BY p)")
    return "WITH " + ", ".join(out) + f" SELECT p AS part, c AS component FROM l{rounds}"


@query_of("part_components", _component_rounds(10))
def part_components(spark: SparkSession, folder: str) -> DataFrame:
    """Parts connected through orders that carry them."""
    edges = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_orderkey").alias("key"))
    return connected_components(edges).select(F.col("node").alias("part"), "component")


@query_of(
    "part_retenders",
    """
    WITH p AS (SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN p_brand END AS scope, replace(p_name, ' ', '') AS sig,
                 p_partkey % 3 = 0 AS again, p_partkey % 4 = 1 AS ended FROM part),
    f AS (SELECT scope, sig, min(k) AS first_k FROM p WHERE ended GROUP BY scope, sig),
    g AS (SELECT p.scope, p.sig, min(k) AS second_k FROM p JOIN f ON p.sig = f.sig AND p.scope IS NOT DISTINCT FROM f.scope
          WHERE ended AND k > first_k GROUP BY p.scope, p.sig)
    SELECT p.k AS notice_key, 'T' || CASE WHEN first_k <> p.k THEN first_k ELSE second_k END AS replaces
    FROM p JOIN f ON p.sig = f.sig AND p.scope IS NOT DISTINCT FROM f.scope
    LEFT JOIN g ON p.sig = g.sig AND p.scope IS NOT DISTINCT FROM g.scope
    WHERE again AND CASE WHEN first_k <> p.k THEN first_k ELSE second_k END IS NOT NULL
    """,
)
def part_retenders(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    k = F.col("p_partkey")
    records = p.select(
        k.alias("notice_key"), k.alias("ordinal"),
        F.when(k % 3 == 0, F.concat(F.lit("Re-tender "), "p_name")).otherwise(F.col("p_name")).alias("title"),
        F.when(F.col("p_size") > 25, F.col("p_brand")).alias("organisation"),
        F.concat(F.lit("T"), k.cast("string")).alias("tender_id"),
        (k % 4 == 1).alias("cancelled"),
    )
    return link_retenders(records, F.lit(True)).filter("replaces is not null").select("notice_key", "replaces")


# --- selection ---------------------------------------------------------------------


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").alias("notice_key"),
        F.col("o_orderkey").alias("ordinal"),
        F.concat_ws("-", F.lit("s"), (F.col("o_custkey") % 12).cast("string")).alias("source_id"),
        F.col("o_orderpriority").alias("grp"),
        F.when(F.col("o_orderstatus") == "P", -1).when(F.col("o_orderpriority") < "3", 3)
        .when(F.col("o_orderpriority") < "4", 2).otherwise(0).alias("rank_value"),
        F.col("o_orderdate").alias("published"),
    )


_CANDIDATE_CTE = """
    c AS (SELECT o_orderkey AS k, 's-' || (o_custkey % 12) AS source_id, o_orderpriority AS grp, o_orderdate AS d,
      CASE WHEN o_orderstatus = 'P' THEN -1 WHEN o_orderpriority < '3' THEN 3 WHEN o_orderpriority < '4' THEN 2 ELSE 0 END AS r FROM orders)
"""


@query_of(
    "order_capped_candidates",
    f"""WITH {_CANDIDATE_CTE} SELECT source_id, k AS notice_key, p::INT AS position FROM (
        SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY r DESC, d DESC, k) AS p FROM c)
        WHERE p <= CASE source_id WHEN 's-0' THEN 12 WHEN 's-1' THEN 8 ELSE 6 END""",
)
def order_capped_candidates(spark: SparkSession, folder: str) -> DataFrame:
    top = selection.capped_candidates(_candidates(spark, folder), {"s-0": 12, "s-1": 8}, 6)
    return top.select("source_id", "notice_key", "position")


@query_of(
    "order_dynamic_cap",
    f"""WITH {_CANDIDATE_CTE}, n AS (SELECT source_id, count(*) FILTER (WHERE r >= 2) AS n FROM c GROUP BY 1)
        SELECT source_id, k AS notice_key, p::INT AS position FROM (
        SELECT c.*, n, row_number() OVER (PARTITION BY c.source_id ORDER BY r DESC, k) AS p FROM c JOIN n USING (source_id))
        WHERE p <= least(128, greatest(20, n))""",
)
def order_dynamic_cap(spark: SparkSession, folder: str) -> DataFrame:
    return selection.dynamic_cap(_candidates(spark, folder)).select("source_id", "notice_key", "position")


@query_of(
    "order_fair_selection",
    f"""WITH {_CANDIDATE_CTE}, g AS (SELECT *, row_number() OVER (PARTITION BY source_id, grp ORDER BY k) AS rank,
          min(k) OVER (PARTITION BY source_id, grp) AS first_k FROM c)
        SELECT source_id, k AS notice_key, grp, p::INT AS position FROM (
          SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY rank, first_k) AS p FROM g) WHERE p <= 16""",
)
def order_fair_selection(spark: SparkSession, folder: str) -> DataFrame:
    c = _candidates(spark, folder).withColumn("priority_categories", F.array("grp"))
    return selection.fair_selection(c).select("source_id", "notice_key", "grp", "position")


@query_of("order_fair_rotated")
def order_fair_rotated(spark: SparkSession, folder: str) -> DataFrame:
    """Rows in up to two groups, queues rotated by cursors; replayed by brute force in tests."""
    c = _candidates(spark, folder)
    second = F.when(F.col("notice_key") % 3 == 0, F.array("grp", F.lit("EXTRA"))).otherwise(F.array("grp"))
    c = c.withColumn("priority_categories", second)
    cursors = c.select("source_id", F.explode("priority_categories").alias("grp")).distinct().withColumn("next", F.lit(5))
    return selection.fair_selection(c, cursors=cursors, chunk=F.floor(F.col("ordinal") / 1000)).select(
        "source_id", "notice_key", "grp", "position"
    )


@query_of(
    "order_deferred",
    f"""WITH {_CANDIDATE_CTE}, t AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY r DESC, d DESC, k) AS p FROM c)
        SELECT source_id, count(*) FILTER (WHERE p > 6) AS deferred FROM t GROUP BY source_id HAVING count(*) FILTER (WHERE p > 6) > 0""",
)
def order_deferred(spark: SparkSession, folder: str) -> DataFrame:
    c = _candidates(spark, folder)
    left = selection.deferred(c, selection.capped_candidates(c, {}, 6))
    return left.groupBy("source_id").agg(F.count(F.lit(1)).alias("deferred"))


@query_of(
    "order_interleave",
    f"""WITH {_CANDIDATE_CTE}, g AS (SELECT *, row_number() OVER (PARTITION BY source_id, grp ORDER BY k) AS turn,
          min(k) OVER (PARTITION BY source_id, grp) AS first_k FROM c)
        SELECT source_id, k AS notice_key, row_number() OVER (PARTITION BY source_id ORDER BY turn, first_k) AS in_region FROM g""",
)
def order_interleave(spark: SparkSession, folder: str) -> DataFrame:
    """Category interleave inside each source, every row kept."""
    c = _candidates(spark, folder)
    order = [f"s-{i}" for i in range(12)]
    out = selection.interleave(c, order, 0, region="source_id", chunk=F.floor(F.col("ordinal") / 1000))
    return out.select("source_id", "notice_key", "in_region")


@query_of(
    "part_term_plan",
    """
    WITH t AS (SELECT DISTINCT p_type, p_name FROM part), g AS (SELECT p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS gi FROM t GROUP BY p_type),
    n AS (SELECT count(*) AS n FROM g), r AS (SELECT p_type, p_name, row_number() OVER (PARTITION BY p_type ORDER BY p_name) - 1 AS ti FROM t)
    SELECT p_type AS grp, p_name AS term, ti::INT AS term_index, ((gi - 2 + n) % n)::INT AS turn FROM r JOIN g USING (p_type), n
    """,
)
def part_term_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Types as term groups, their distinct names as terms, rotated by two."""
    names = table(spark, folder, "part").groupBy("p_type").agg(F.array_sort(F.collect_set("p_name")).alias("terms"))
    order = F.array_sort(F.collect_set("p_type"))
    all_types = names.agg(order.alias("types"))
    terms = names.crossJoin(all_types).select(  # one-row side
        (F.array_position("types", F.col("p_type")) - 1).cast("int").alias("group_index"), F.col("p_type").alias("grp"), "terms"
    )
    return selection.term_plan(terms, 2).select("grp", "term", "term_index", F.col("turn").cast("int").alias("turn"))


# --- search ------------------------------------------------------------------------


def part_tenders(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as result rows."""
    p = table(spark, folder, "part")
    k = F.col("p_partkey")
    closing = F.date_add(F.lit("2026-09-01").cast("date"), (F.col("p_size")).cast("int"))
    brand = F.struct(
        F.col("p_brand").alias("brand"),
        F.when(k % 2 == 0, "portfolio").otherwise("explicit-brand").alias("match_type"),
        F.array("p_name").alias("terms"),
    )
    return p.select(
        k.alias("notice_key"), k.alias("ordinal"), F.col("p_name").alias("title"), F.lit("parts").alias("source_id"),
        F.lit(None).cast("string").alias("tender_url"), F.lit("https://parts.gov.in/list").alias("source_url"),
        F.when(k % 3 == 0, "North").otherwise("South").alias("region"),
        F.array("p_type").alias("categories"),
        F.when(F.col("p_type") == "PROMO", F.array(F.lit("PRIORITY"))).otherwise(F.array().cast("array<string>")).alias("priority_categories"),
        F.when(k % 4 == 0, F.array().cast("array<struct<brand:string,match_type:string,terms:array<string>>>")).otherwise(F.array(brand)).alias("brand_matches"),
        F.split("p_name", " ").alias("matched_keywords"),
        (F.col("p_retailprice") / 10000).alias("confidence"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(F.date_format(closing, "yyyy-MM-dd")).alias("effective_closing_date"),
        F.when(k % 7 == 0, "DEADLINE_UNKNOWN").when(k % 11 == 0, "CANCELLED").otherwise("ACTIVE_LIKELY").alias("status"),
        F.lit("2026-08-01").alias("publish_date"), F.lit("2026-09-10T06:00:00Z").alias("fetched_at"),
        F.lit("day").alias("date_precision"),
    )


PART_NOW = "2026-09-10 12:00:00"
_PART_CTE = """
    p AS (SELECT p_partkey AS k, p_name, p_brand, p_type, p_size, p_retailprice,
      CASE WHEN p_partkey % 3 = 0 THEN 'North' ELSE 'South' END AS region,
      CASE WHEN p_partkey % 7 <> 0 THEN p_size - 9 END AS days,
      CASE WHEN p_partkey % 7 = 0 THEN 'DEADLINE_UNKNOWN' WHEN p_partkey % 11 = 0 THEN 'CANCELLED'
           WHEN p_size < 9 THEN 'EXPIRED' ELSE 'ACTIVE_LIKELY' END AS status FROM part)
"""


@query_of(
    "part_search",
    f"""WITH {_PART_CTE} SELECT k AS notice_key, status FROM p
        WHERE status = 'ACTIVE_LIKELY' AND contains(lower(p_name || ' ' || p_type || ' ' || p_brand), 'red')
          AND contains(lower(p_name || ' ' || p_type || ' ' || p_brand), 'o') AND region = 'South'
          AND days BETWEEN 0 AND 30 AND k % 4 <> 0 AND k % 2 = 1""",
)
def part_search(spark: SparkSession, folder: str) -> DataFrame:
    """Keywords, region, closing window and an explicit brand together."""
    f = search.Filters(query=" RED o", region="South", closing=30, explicit=True)
    rows = status.refresh_elapsed(part_tenders(spark, folder), clock(PART_NOW))
    return search.filter_tenders(rows, f, clock(PART_NOW)).select("notice_key", "status")


@query_of(
    "part_closing_order",
    f"""WITH {_PART_CTE}, s AS (SELECT k, row_number() OVER (ORDER BY days ASC NULLS LAST, p_type = 'PROMO' DESC,
          k % 4 <> 0 DESC, k) AS position FROM p WHERE status = 'ACTIVE_LIKELY')
        SELECT k AS notice_key, position FROM s""",
)
def part_closing_order(spark: SparkSession, folder: str) -> DataFrame:
    """The closing order with positions: places inside the sorted ranges plus the rows of the ranges before."""
    rows = search.filter_and_sort(part_tenders(spark, folder), search.Filters(), clock(PART_NOW))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    placed = cut(rows.select("notice_key", F.spark_partition_id().alias("part"), place.alias("place")))
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.selectExpr("part", "sum(n) OVER (ORDER BY part) - n AS before")  # a row for each range
    return placed.join(before, "part").select("notice_key", (F.col("before") + F.col("place") + 1).alias("position"))


@query_of(
    "part_facets",
    f"""WITH {_PART_CTE}, f AS (
          SELECT 'region' AS facet, region AS value, status FROM p UNION ALL SELECT 'category', p_type, status FROM p
          UNION ALL SELECT 'status', status, status FROM p UNION ALL SELECT 'priority', 'PRIORITY', status FROM p WHERE p_type = 'PROMO')
        SELECT facet, value, count(*) FILTER (WHERE status = 'ACTIVE_LIKELY') AS active,
          count(*) FILTER (WHERE status = 'DEADLINE_UNKNOWN') AS unknown FROM f GROUP BY facet, value""",
)
def part_facets(spark: SparkSession, folder: str) -> DataFrame:
    rows = status.refresh_elapsed(part_tenders(spark, folder), clock(PART_NOW))
    return search.facet_counts(
        rows,
        {"region": F.col("region"), "category": F.col("categories"), "status": F.col("status"), "priority": F.col("priority_categories")},
        {"active": search.active(F.col("status")), "unknown": F.col("status") == "DEADLINE_UNKNOWN"},
    )


@query_of(
    "part_headline",
    f"""WITH {_PART_CTE} SELECT (SELECT count(*) FROM nation) AS entities, (SELECT count(DISTINCT n_regionkey) FROM nation) AS regions,
          count(*) FILTER (WHERE status = 'ACTIVE_LIKELY') AS active, 0::BIGINT AS verified,
          count(*) FILTER (WHERE status = 'ACTIVE_LIKELY') AS likely,
          count(*) FILTER (WHERE status = 'ACTIVE_LIKELY' AND days BETWEEN 0 AND 7) AS closing_in_7_days,
          count(*) FILTER (WHERE status = 'DEADLINE_UNKNOWN') AS deadline_unknown FROM p""",
)
def part_headline(spark: SparkSession, folder: str) -> DataFrame:
    rows = status.refresh_elapsed(part_tenders(spark, folder), clock(PART_NOW))
    entities = table(spark, folder, "nation").select(F.col("n_regionkey").alias("region"))
    return search.headline(rows, entities, clock(PART_NOW))


# --- audits ------------------------------------------------------------------------


@query_of(
    "line_source_funnel",
    """
    SELECT 'supplier-' || l_suppkey AS source_id, count(*) AS raw_records,
      count(*) FILTER (WHERE l_quantity > 10) AS institution_matches,
      count(*) FILTER (WHERE (l_quantity > 10 OR l_linestatus = 'O') AND l_returnflag = 'A') AS medical_matches,
      count(*) FILTER (WHERE (l_quantity > 10 OR l_linestatus = 'O') AND l_returnflag <> 'A') AS false_positives_rejected,
      count(*) FILTER (WHERE NOT (l_quantity > 10 OR l_linestatus = 'O')) AS unassigned_rejected
    FROM lineitem GROUP BY 1
    """,
)
def line_source_funnel(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem").select(
        F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")).alias("source_id"),
        (F.col("l_quantity") > 10).cast("int").alias("entity_count"),
        (F.col("l_linestatus") == "O").alias("is_statewide"),
        (F.col("l_returnflag") == "A").alias("is_relevant"),
    )
    return quality.source_funnel(li)


def _entities(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "nation")
    k = F.col("n_nationkey")
    return n.select(
        k.cast("string").alias("id"), F.col("n_name").alias("short_name"), F.col("n_regionkey").cast("string").alias("region"),
        F.array(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.concat(F.lit("m"), (k % 3).cast("string"))).alias("source_ids"),
    )


def _source_states(spark: SparkSession, folder: str) -> DataFrame:
    """Regions and market groups as sources with a state and a raw count."""
    n = table(spark, folder, "nation")
    r = n.groupBy(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("source_id")).agg(F.count(F.lit(1)).alias("raw_records"))
    m = n.groupBy(F.concat(F.lit("m"), (F.col("n_nationkey") % 3).cast("string")).alias("source_id")).agg(F.count(F.lit(1)).alias("raw_records"))
    both = r.unionByName(m)
    state = F.when(F.col("source_id").isin("r0", "m1"), "PARTIAL").when(F.col("source_id") == "r3", "UNAVAILABLE").otherwise("SUCCESS")
    return both.withColumns({"status": state, "stale": F.col("source_id") == "m2"})


def _customer_tenders(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("notice_key"),
        F.when(k % 3 == 0, F.col("c_nationkey").cast("string")).alias("institution_id"),
        F.array(
            F.struct(F.col("c_nationkey").cast("string").alias("institution_id"), F.lit("a").alias("name")),
            F.struct(((F.col("c_nationkey") + 1) % 25).cast("string").alias("institution_id"), F.lit("b").alias("name")),
        ).alias("consignees"),
        F.when(F.col("c_acctbal") < 0, "EXPIRED").when(F.col("c_mktsegment") == "MACHINERY", "DEADLINE_UNKNOWN").otherwise("ACTIVE_LIKELY").alias("status"),
        F.when(k % 3 == 0, "institution").otherwise("statewide").alias("procurement_scope"),
        (F.col("c_nationkey") % 5).cast("string").alias("region"),
    )


_ENTITY_CTE = """
    src AS (SELECT 'r' || n_regionkey AS source_id, count(*) AS raw FROM nation GROUP BY 1
            UNION ALL SELECT 'm' || (n_nationkey % 3), count(*) FROM nation GROUP BY 1),
    st AS (SELECT *, CASE WHEN source_id IN ('r0', 'm1') THEN 'PARTIAL' WHEN source_id = 'r3' THEN 'UNAVAILABLE' ELSE 'SUCCESS' END AS status FROM src),
    es AS (SELECT n_nationkey AS e, unnest(['r' || n_regionkey, 'm' || (n_nationkey % 3)]) AS source_id FROM nation),
    ps AS (SELECT e, count(*) AS attempted, count(*) FILTER (WHERE status = 'SUCCESS') AS successful,
             count(*) FILTER (WHERE status = 'PARTIAL') AS part, count(*) FILTER (WHERE status = 'UNAVAILABLE') AS gone, sum(raw) AS raw,
             bool_or(status <> 'SUCCESS' OR source_id = 'm2') AS bad
           FROM es JOIN st USING (source_id) GROUP BY e),
    t AS (SELECT c_custkey, c_nationkey % 5 AS reg, c_nationkey, CASE WHEN c_acctbal < 0 THEN 'EXPIRED' WHEN c_mktsegment = 'MACHINERY'
            THEN 'DEADLINE_UNKNOWN' ELSE 'ACTIVE_LIKELY' END AS status FROM customer),
    et AS (SELECT c_nationkey AS e, status FROM t UNION ALL SELECT (c_nationkey + 1) % 25, status FROM t),
    pt AS (SELECT e, count(*) AS total, count(*) FILTER (WHERE status = 'ACTIVE_LIKELY') AS act,
             count(*) FILTER (WHERE status = 'DEADLINE_UNKNOWN') AS unk, count(*) FILTER (WHERE status = 'EXPIRED') AS exp FROM et GROUP BY e)
"""


@query_of(
    "nation_cards",
    f"""WITH {_ENTITY_CTE}, rg AS (SELECT reg, count(*) AS n FROM t WHERE c_custkey % 3 <> 0 AND status = 'ACTIVE_LIKELY' GROUP BY reg)
        SELECT n_nationkey::VARCHAR AS entity_id, n_regionkey::VARCHAR AS region, coalesce(act, 0) AS direct_active, coalesce(unk, 0) AS deadline_unknown,
          coalesce(total, 0) AS total, coalesce(rg.n, 0) AS regional_active, coalesce(bad, true) AS incomplete
        FROM nation LEFT JOIN pt ON pt.e = n_nationkey LEFT JOIN rg ON rg.reg = n_regionkey LEFT JOIN ps ON ps.e = n_nationkey""",
)
def nation_cards(spark: SparkSession, folder: str) -> DataFrame:
    return quality.entity_cards(_entities(spark, folder), _source_states(spark, folder), _customer_tenders(spark, folder))


@query_of(
    "nation_diagnostics",
    f"""WITH {_ENTITY_CTE}, rw AS (SELECT s_nationkey AS e, count(*) AS n, count(*) FILTER (WHERE s_acctbal > 0) AS rel FROM supplier GROUP BY 1)
        SELECT n_nationkey::VARCHAR AS entity_id, n_name AS name, coalesce(attempted, 0) AS sources_attempted, coalesce(successful, 0) AS sources_successful,
          coalesce(part, 0) AS sources_partial, coalesce(gone, 0) AS sources_unavailable, coalesce(raw, 0)::BIGINT AS raw_records,
          coalesce(n, 0) AS institution_matches, coalesce(rel, 0) AS medical_matches, coalesce(n, 0) - coalesce(rel, 0) AS false_positives_rejected,
          greatest(0, coalesce(rel, 0) - coalesce(total, 0)) AS duplicates_removed, 0::BIGINT AS active_verified, coalesce(act, 0) AS active_likely,
          coalesce(unk, 0) AS deadline_unknown, coalesce(exp, 0) AS expired,
          CASE WHEN coalesce(act, 0) > 0 THEN NULL WHEN coalesce(attempted, 0) > coalesce(successful, 0)
            THEN 'none-found-incomplete-coverage'
            ELSE 'none-found-full-coverage' END AS zero_active_reason
        FROM nation LEFT JOIN ps ON ps.e = n_nationkey LEFT JOIN rw ON rw.e = n_nationkey LEFT JOIN pt ON pt.e = n_nationkey""",
)
def nation_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "supplier").select(
        F.array(F.struct(F.col("s_nationkey").cast("string").alias("id"))).alias("matched"), (F.col("s_acctbal") > 0).alias("is_relevant")
    )
    return quality.entity_diagnostics(_entities(spark, folder), _source_states(spark, folder), raw, _customer_tenders(spark, folder))


@query_of(
    "order_completeness",
    """
    WITH f AS (SELECT 's-' || (o_custkey % 12) AS source_id, count(DISTINCT o_custkey) AS parsed, count(*) AS n FROM orders GROUP BY 1),
    r AS (SELECT 's-' || (c_custkey % 12) AS source_id, count(*) AS reported FROM customer GROUP BY 1)
    SELECT source_id, reported, coalesce(parsed, 0) AS parsed, CASE WHEN reported > coalesce(parsed, 0) THEN 'PARTIAL' ELSE 'SUCCESS' END AS status
    FROM r LEFT JOIN f USING (source_id)
    """,
)
def order_completeness(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as reported listing sizes, ordering customers as parsed ids."""
    source = lambda c: F.concat(F.lit("s-"), (F.col(c) % 12).cast("string")).alias("source_id")
    reported = table(spark, folder, "customer").groupBy(source("c_custkey")).agg(F.count(F.lit(1)).alias("reported"))
    parsed = table(spark, folder, "orders").select(source("o_custkey"), F.col("o_custkey").alias("tender_id"))
    return quality.listing_completeness(reported, parsed)


@query_of(
    "order_discovery_metrics",
    f"""WITH {_CANDIDATE_CTE} SELECT source_id, count(*) FILTER (WHERE r = 2) AS generic_candidates,
          count(*) FILTER (WHERE r = 3 AND k % 5 = 0) AS rejected_candidates, count(*) FILTER (WHERE k % 2 = 0) AS inspected_candidates,
          count(*) FILTER (WHERE k % 2 = 1) AS deferred_candidates, count(*) FILTER (WHERE r = 3 AND grp = '1-URGENT') AS urgent FROM c GROUP BY 1""",
)
def order_discovery_metrics(spark: SparkSession, folder: str) -> DataFrame:
    c = _candidates(spark, folder).select(
        "source_id",
        F.when(F.col("rank_value") == 3, F.array("grp")).otherwise(F.array().cast("array<string>")).alias("discovery_groups"),
        (F.col("rank_value") == 2).alias("is_generic"),
        (F.col("notice_key") % 5 != 0).alias("is_title_relevant"),
        (F.col("notice_key") % 2 == 0).alias("is_selected"),
        (F.col("notice_key") % 2 == 1).alias("is_deferred"),
    )
    m = quality.discovery_metrics(c)
    return m.withColumn("urgent", F.coalesce(F.try_element_at("raw_candidates", F.lit("1-URGENT")), F.lit(0))).drop("raw_candidates")


@query_of(
    "order_included_per_source",
    """
    WITH r AS (SELECT l_orderkey, 'supplier-' || l_suppkey AS source_id FROM lineitem)
    SELECT source_id, count(DISTINCT l_orderkey) AS included FROM r GROUP BY 1
    """,
)
def order_included_per_source(spark: SparkSession, folder: str) -> DataFrame:
    refs = table(spark, folder, "lineitem").select(
        F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")).alias("source_id"), F.col("l_orderkey").alias("notice_key")
    )
    return quality.included_per_source(refs)


# --- snapshots ---------------------------------------------------------------------


def event_snapshots(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """One snapshot per user and day; its errors decide its status, its other events are its records."""
    e = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("source_id"),
        F.date_trunc("day", F.col("ts")).alias("attempted_at"),
        F.concat_ws("/", "event_type", (F.col("event_id") % 10).cast("string")).alias("identity"),
        F.col("ts").alias("observed_at"), "event_type", "event_id",
    )
    errors = F.count_if(F.col("event_type") == "error")
    control = e.groupBy("source_id", "attempted_at").agg(
        F.when(errors >= 2, "UNAVAILABLE").when(errors == 1, "PARTIAL").otherwise("SUCCESS").alias("status"),
        F.max("observed_at").alias("successful_at"),
    )
    first = e.filter("event_type <> 'error'").groupBy("source_id", "attempted_at", "identity").agg(
        F.max("observed_at").alias("observed_at"), F.max("event_id").alias("event_id")
    )
    return control, first


EVENT_INDEX = "cast(source_id as int) % 2 = 0"
_SNAPSHOT_CTE = """
    e AS (SELECT user_id::VARCHAR AS s, date_trunc('day', ts) AS d, event_type || '/' || (event_id % 10) AS identity, ts, event_type, event_id FROM events),
    c AS (SELECT s, d, CASE WHEN count(*) FILTER (WHERE event_type = 'error') >= 2 THEN 'UNAVAILABLE'
            WHEN count(*) FILTER (WHERE event_type = 'error') = 1 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status, max(ts) AS seen FROM e GROUP BY 1, 2),
    r AS (SELECT s, d, identity, max(ts) AS ts, max(event_id) AS event_id FROM e WHERE event_type <> 'error' GROUP BY 1, 2, 3),
    m AS (SELECT s, max(d) FILTER (WHERE status = 'SUCCESS' OR (status = 'PARTIAL' AND s::INT % 2 <> 0)) AS full_at,
            max(d) FILTER (WHERE status <> 'UNAVAILABLE') AS ok_at, max(d) AS last_at FROM c GROUP BY 1),
    n AS (SELECT c.*, min(c2.d) AS next_at FROM c LEFT JOIN c c2 ON c2.s = c.s AND c2.d > c.d AND c2.status <> 'UNAVAILABLE' GROUP BY ALL)
"""


@query_of(
    "event_latest_records",
    f"""WITH {_SNAPSHOT_CTE}, live AS (SELECT r.*, full_at, ok_at, last_at, next_at FROM r JOIN n ON n.s = r.s AND n.d = r.d AND n.status <> 'UNAVAILABLE'
          JOIN m ON m.s = r.s WHERE full_at IS NULL OR r.d >= full_at),
        q AS (SELECT *, row_number() OVER (PARTITION BY s, identity ORDER BY d DESC) AS p FROM live)
        SELECT s AS source_id, identity, event_id, NOT (d = ok_at) OR last_at > ok_at AS stale FROM q WHERE p = 1 AND (d = ok_at OR
          (ok_at - ts <= INTERVAL 24 HOUR AND ts - next_at <= INTERVAL 5 MINUTE))""",
)
def event_latest_records(spark: SparkSession, folder: str) -> DataFrame:
    """Retention over thirty daily snapshots; even users are index sources."""
    control, records = event_snapshots(spark, folder)
    return snapshots.latest_records(control, records, F.expr(EVENT_INDEX)).select("source_id", "identity", "event_id", "stale")


@query_of(
    "event_latest_snapshots",
    f"""WITH {_SNAPSHOT_CTE} SELECT c.s AS source_id, arg_max(status, d) AS status, max(d) AS attempted_at,
          arg_max(seen, d) FILTER (WHERE status <> 'UNAVAILABLE') AS successful_at,
          arg_max(status, d) = 'UNAVAILABLE' AND bool_or(status <> 'UNAVAILABLE') AS stale FROM c GROUP BY 1""",
)
def event_latest_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    control, _records = event_snapshots(spark, folder)
    out = snapshots.latest_snapshots(control)
    return out.select("source_id", "status", "attempted_at", "successful_at", "stale")


@query_of(
    "event_read_state",
    """
    WITH c AS (SELECT user_id::VARCHAR AS source_id, max(ts) AS seen, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1),
    a AS (SELECT *, epoch_us(TIMESTAMP '2024-01-30 20:00:00') - epoch_us(date_trunc('second', seen)) AS age FROM c)
    SELECT source_id, errors > 15 OR age > 900000000 OR age < -300000000 AS stale,
      CASE WHEN errors > 15 THEN 'UNAVAILABLE' WHEN age > 900000000 OR age < -300000000 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status FROM a
    """,
)
def event_read_state(spark: SparkSession, folder: str) -> DataFrame:
    """Users as sources read at a fixed clock: old or future observations are stale."""
    e = table(spark, folder, "events").groupBy(F.col("user_id").cast("string").alias("source_id")).agg(
        F.max("ts").alias("seen"), F.count_if(F.col("event_type") == "error").alias("errors")
    )
    text = F.concat(F.date_format("seen", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    rows = e.select(
        "source_id", text.alias("successful_at"), text.alias("attempted_at"), (F.col("errors") > 15).alias("stale"),
        F.when(F.col("errors") > 15, "UNAVAILABLE").otherwise("SUCCESS").alias("status"),
    )
    return snapshots.read_staleness(rows, clock("2024-01-30 20:00:00")).select("source_id", "stale", "status")


@query_of(
    "order_agreed_values",
    """
    SELECT l_orderkey AS notice_key, CASE WHEN min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) END AS flag,
      CASE WHEN min(l_quantity) = max(l_quantity) THEN min(l_quantity)::INT END AS quantity FROM lineitem GROUP BY 1
    """,
)
def order_agreed_values(spark: SparkSession, folder: str) -> DataFrame:
    """Values all lines of an order agree on, else NULL."""
    return table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("notice_key")).agg(
        one_distinct(F.col("l_returnflag")).alias("flag"), one_distinct(F.col("l_quantity").cast("int")).alias("quantity")
    )


# --- feed --------------------------------------------------------------------------

ORIGIN = "https://feed.gov.in"


def order_feed_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Orders as notices: a third declare their lines as items, a third state quantities, a third have schedule rows."""
    o, li = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    k, line = F.col("o_orderkey"), F.col("l_orderkey") % 3
    item = F.struct(
        F.lit(None).cast("string").alias("id"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("name"),
        F.col("l_quantity").cast("int").cast("string").alias("quantity_text"), F.col("l_returnflag").alias("category"),
        F.lit("/items").alias("source_url"), F.lit("Lines").alias("source_label"), F.col("l_linenumber").cast("int").alias("source_page"),
        F.lit(None).cast("string").alias("source_sheet"), F.lit(None).cast("int").alias("source_row"),
    )
    # An order has few lines by construction; the guard still checks the count.
    declared = F.when(line == 0, F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", item.alias("item")))
    lines = li.groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(declared)), lambda x: x["item"]).alias("equipment_items")
    )
    notices = o.join(lines, k == F.col("l_orderkey"), "left").select(
        k.alias("notice_key"), F.concat(F.lit("o"), k.cast("string")).alias("id"),
        F.concat(F.lit("Order of <b>"), F.col("o_orderpriority"), F.lit("</b>")).alias("title"),
        F.concat(F.lit("https://orders.gov.in/o/"), k.cast("string")).alias("tender_url"), F.lit(None).cast("string").alias("source_url"),
        "equipment_items",
        F.array(F.lit("x")).alias("equipment_types"), F.lit("orders").alias("source_id"), F.lit("Orders").alias("source_name"),
        iso_day(F.col("o_orderdate")).alias("publish_date"),
        iso_day(F.date_add("o_orderdate", F.when(F.col("o_orderstatus") == "F", 30).otherwise(60))).alias("effective_closing_date"),
        F.lit("1998-09-15T06:00:00Z").alias("fetched_at"),
    )
    amount = F.col("l_quantity").cast("int").cast("string")
    schedule = line == 2
    quantities = li.select(
        F.col("l_orderkey").alias("notice_key"),
        F.when(schedule, F.concat(F.lit("Row part "), F.col("l_partkey").cast("string")))
        .otherwise(F.concat(F.lit("Total quantity: "), amount, F.lit(" nos"))).alias("requirement"),
        amount.alias("quantity"), F.lit("https://orders.gov.in/q.pdf").alias("doc_url"),
        F.when(schedule, "boq").otherwise("tender-document").alias("doc_type"), F.lit("Quantity").alias("label"), F.lit(1).alias("page"),
        F.when(schedule, F.col("l_linestatus")).alias("sheet"), F.when(schedule, F.col("l_linenumber").cast("int")).alias("row"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_linestatus").alias("ordinal"),
    )
    return notices, quantities


@query_of(
    "order_feed_items",
    """
    WITH li AS (SELECT *, l_quantity::INT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) AS i,
                  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_linestatus) - 1 AS j
                FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    s AS (SELECT l_orderkey AS k, CASE WHEN min(q) = max(q) THEN min(q) END AS q FROM li WHERE l_orderkey % 3 = 1 GROUP BY 1)
    SELECT l_orderkey AS notice_key, 1 AS tier, 'item-' || i AS item_id, 'Part ' || l_partkey AS equipment, q AS quantity, l_returnflag AS category, 'Lines' AS source_label
    FROM li WHERE l_orderkey % 3 = 0
    UNION ALL
    SELECT l_orderkey, 2, 'boq-' || l_linestatus || '-' || l_linenumber || '-' || j, 'Row part ' || l_partkey, q, NULL, 'Quantity' FROM li WHERE l_orderkey % 3 = 2
    UNION ALL
    SELECT o_orderkey, 3, 'unstructured-title', 'Order of ' || o_orderpriority, s.q, NULL,
      CASE WHEN s.q IS NOT NULL THEN 'Quantity' ELSE 'Tender title; review equipment lines' END
    FROM orders LEFT JOIN s ON s.k = o_orderkey WHERE o_orderkey % 3 = 1 OR o_orderkey NOT IN (SELECT l_orderkey FROM li)
    """,
)
def order_feed_items(spark: SparkSession, folder: str) -> DataFrame:
    items = feed.feed_items(*order_feed_inputs(spark, folder), ORIGIN)
    return items.select("notice_key", "tier", "item_id", "equipment", "quantity", "category", "source_label")


@query_of(
    "order_feed_changes",
    """
    SELECT 'o' || o_orderkey AS external_id, CASE WHEN o_orderkey % 10 = 0 THEN 'new' WHEN o_orderstatus = 'F' THEN 'same' ELSE 'changed' END AS change
    FROM orders
    """,
)
def order_feed_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of today's feed against an earlier delivery in which open orders closed sooner."""
    notices, quantities = order_feed_inputs(spark, folder)
    now, _rejected = feed.feed_notices(notices, quantities, ORIGIN)
    delivered_rows = notices.filter("notice_key % 10 <> 0").withColumns(
        {
            "effective_closing_date": iso_day(F.date_add(F.to_date("publish_date"), 30)),
            "fetched_at": F.lit("1998-01-01T00:00:00Z"),
        }
    )
    before, _rejected = feed.feed_notices(delivered_rows, quantities, ORIGIN)
    return feed.detect_changes(now, before).select("external_id", "change")
