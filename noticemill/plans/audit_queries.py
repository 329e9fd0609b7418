"""Example queries on displays, ranks, windows, audits and merges of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import deadline_display, wall_clock_date
from ..functions.text import cancelled_words, document_type, product_evidence, withdrawn_words
from ..operators import quality, selection, snapshots
from ..operators.ranking import last_rows
from ..sources.html import linked_documents
from .record_queries import EVENT_INDEX
from .tables import clock, iso_day, spread, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query_of(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return keep


@query_of(
    "order_deadline_text",
    """
    WITH d AS (SELECT o_orderkey AS k, o_orderdate::TIMESTAMP AS t FROM orders)
    SELECT k, CASE k % 4 WHEN 0 THEN 'Deadline unknown' WHEN 1 THEN strftime(t, '%d %b %Y') || ' · Time not confirmed'
      WHEN 2 THEN strftime(t + INTERVAL 15 HOUR, '%d %b %Y, %I:%M pm') || ' IST'
      ELSE strftime(t + INTERVAL 1 DAY, '%d %b %Y') || ' · Time not confirmed' END AS shown
    FROM d
    """,
)
def order_deadline_text(spark: SparkSession, folder: str) -> DataFrame:
    """Deadlines without a date, with a bare day, with a clock time, and with one of day precision past local midnight."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    day, k = iso_day(F.col("o_orderdate")), F.col("o_orderkey") % 4
    text = (
        F.when(k == 0, "soon")
        .when(k == 1, day)
        .when(k == 2, F.concat(day, F.lit("T09:30:00Z")))
        .otherwise(F.concat(day, F.lit("T18:45:00Z")))
    )
    shown = deadline_display(text, F.when(k == 3, "day").otherwise("minute"))
    return o.select(F.col("o_orderkey").alias("k"), shown.alias("shown"))


@query_of(
    "order_wall_clock",
    """
    SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate + INTERVAL 10 YEAR, '%Y-%m-%d') || 'T15:04:00+05:30' END AS local_time
    FROM orders
    """,
)
def order_wall_clock(spark: SparkSession, folder: str) -> DataFrame:
    """Index values whose Z stands for local time; other forms are refused."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    day = iso_day(F.add_months("o_orderdate", 120))
    k = F.col("o_orderkey") % 3
    value = F.concat(day, F.when(k == 0, "T15:04:00Z").when(k == 1, "T15:04:00.000Z").otherwise("T15:04:00+01:00"))
    return o.select(F.col("o_orderkey").alias("k"), wall_clock_date(value).alias("local_time"))


@query_of(
    "part_document_types",
    """
    WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'Corrigendum of ' WHEN 1 THEN 'Price Schedule ' WHEN 2 THEN 'Technical ' WHEN 3 THEN 'BOQ ' ELSE '' END || p_name AS label,
                CASE WHEN p_partkey % 7 = 0 THEN 'https://a.gov.in/x.XLSX?v=1' ELSE 'https://a.gov.in/x.pdf' END AS url FROM part)
    SELECT k, CASE WHEN regexp_matches(label, '(?i)corrig|amend|addendum|extension') THEN 'corrigendum'
      WHEN k % 7 = 0 OR k % 5 IN (1, 3) THEN 'boq'
      WHEN regexp_matches(label, '(?i)technical|specification|annexure') THEN 'technical-specification' ELSE 'tender-document' END AS doc_type,
      k % 11 = 0 AS cancelled, k % 11 = 1 AS withdrawn
    FROM p
    """,
)
def part_document_types(spark: SparkSession, folder: str) -> DataFrame:
    """Labels as document types, and notices of cancellation and withdrawal."""
    p = table(spark, folder, "part").select("p_partkey", "p_name")
    k = F.col("p_partkey")
    head = F.when(k % 5 == 0, "Corrigendum of ").when(k % 5 == 1, "Price Schedule ").when(k % 5 == 2, "Technical ").when(k % 5 == 3, "BOQ ")
    label = F.concat(F.coalesce(head, F.lit("")), F.col("p_name"))
    url = F.when(k % 7 == 0, "https://a.gov.in/x.XLSX?v=1").otherwise("https://a.gov.in/x.pdf")
    words = F.concat(F.col("p_name"), F.when(k % 11 == 0, " Cancelled").when(k % 11 == 1, ": withdrawal.").otherwise(" uncancelledness"))
    return p.select(
        k.alias("k"), document_type(label, url).alias("doc_type"), cancelled_words(words).alias("cancelled"), withdrawn_words(words).alias("withdrawn")
    )


def _status_tenders(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as notices with a status, a deadline and documents."""
    c = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    k = F.col("c_custkey")
    link = F.struct(F.lit("a").alias("label"), F.lit("u").alias("url"))
    return c.select(
        k.alias("notice_key"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("source_id"),
        F.when(F.col("c_acctbal") < 0, "EXPIRED").when(F.col("c_mktsegment") == "MACHINERY", "DEADLINE_UNKNOWN")
        .when(F.col("c_mktsegment") == "BUILDING", "CANCELLED").when(k % 2 == 0, "ACTIVE_VERIFIED").otherwise("ACTIVE_LIKELY").alias("status"),
        F.when(k % 3 == 0, "2026-01-01").when(k % 3 == 1, "unreadable").alias("effective_closing_date"),
        F.when(k % 4 == 0, F.array(link, link)).when(k % 4 == 1, F.array(link)).alias("documents"),
        F.when(k % 5 == 0, "statewide").otherwise("institution").alias("procurement_scope"),
        F.when(k % 5 != 0, F.col("c_nationkey").cast("string")).alias("institution_id"),
        F.when(k % 6 == 0, F.array(F.struct(((F.col("c_nationkey") + 1) % 25).cast("string").alias("institution_id"), F.lit("x").alias("name")))).alias("consignees"),
        F.when(k % 7 > 2, "Punjab").alias("resolved_region"),
    )


_STATUS = """CASE WHEN c_acctbal < 0 THEN 'EXPIRED' WHEN c_mktsegment = 'MACHINERY' THEN 'DEADLINE_UNKNOWN'
    WHEN c_mktsegment = 'BUILDING' THEN 'CANCELLED' WHEN c_custkey % 2 = 0 THEN 'ACTIVE_VERIFIED' ELSE 'ACTIVE_LIKELY' END"""


@query_of(
    "customer_source_inventory",
    f"""
    SELECT 'n' || c_nationkey AS source_id, count(*) FILTER (WHERE c_custkey % 3 = 0) AS dates_available,
      sum(CASE c_custkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END)::BIGINT AS documents_linked,
      count(*) FILTER (WHERE {_STATUS} = 'DEADLINE_UNKNOWN') AS deadline_unknown_relevant
    FROM customer GROUP BY c_nationkey
    """,
)
def customer_source_inventory(spark: SparkSession, folder: str) -> DataFrame:
    t = _status_tenders(spark, folder)
    return quality.source_inventory(t, t)


@query_of(
    "customer_omitted",
    "SELECT 'n' || c_nationkey AS source_id, count(*) FILTER (WHERE c_custkey % 7 <= 2) AS omitted FROM customer GROUP BY c_nationkey",
)
def customer_omitted(spark: SparkSession, folder: str) -> DataFrame:
    """National rows without a monitored region."""
    return quality.omitted_without_region(_status_tenders(spark, folder))


@query_of(
    "customer_run_totals",
    f"""
    WITH s AS (SELECT n_nationkey AS k, CASE n_nationkey % 4 WHEN 0 THEN 'PARTIAL' WHEN 1 THEN 'UNAVAILABLE' ELSE 'SUCCESS' END AS status FROM nation),
    t AS (SELECT *, {_STATUS} AS status FROM customer),
    a AS (SELECT * FROM t WHERE status LIKE 'ACTIVE%'),
    e AS (SELECT c_nationkey AS e FROM a WHERE c_custkey % 5 <> 0 UNION SELECT (c_nationkey + 1) % 25 FROM a WHERE c_custkey % 6 = 0)
    SELECT (SELECT count(*) FROM s) AS sources_attempted, (SELECT count(*) FROM s WHERE status = 'SUCCESS') AS sources_successful,
      (SELECT count(*) FROM s WHERE status = 'PARTIAL') AS sources_partial, (SELECT count(*) FROM s WHERE status = 'UNAVAILABLE') AS sources_unavailable,
      (SELECT count(DISTINCT e) FROM e) AS active_entities, (SELECT count(*) FROM a WHERE c_custkey % 5 = 0) AS active_statewide,
      (SELECT '2026-09-' || lpad(max(k + 1)::VARCHAR, 2, '0') FROM s WHERE status <> 'UNAVAILABLE') AS last_refreshed
    """,
)
def customer_run_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of one run and its latest refresh."""
    n = table(spark, folder, "nation")
    k = F.col("n_nationkey")
    s = n.select(
        k.cast("string").alias("source_id"),
        F.when(k % 4 == 0, "PARTIAL").when(k % 4 == 1, "UNAVAILABLE").otherwise("SUCCESS").alias("status"),
        F.when(k % 4 != 1, F.concat(F.lit("2026-09-"), F.lpad((k + 1).cast("string"), 2, "0"))).alias("successful_at"),
    )
    return quality.run_totals(s, _status_tenders(spark, folder)).crossJoin(quality.last_refreshed(s))  # one row each


@query_of(
    "customer_summary",
    f"""
    WITH f AS (SELECT count(*) AS raw_records, count(*) FILTER (WHERE l_quantity > 10) AS institution_matched,
        count(*) FILTER (WHERE (l_quantity > 10 OR l_linestatus = 'O') AND l_returnflag = 'A') AS medical_relevant,
        count(*) FILTER (WHERE (l_quantity > 10 OR l_linestatus = 'O') AND l_returnflag <> 'A') AS false_positives_rejected,
        count(*) FILTER (WHERE NOT (l_quantity > 10 OR l_linestatus = 'O')) AS unassigned_rejected FROM lineitem),
    t AS (SELECT {_STATUS} AS status FROM customer)
    SELECT f.*, medical_relevant - (SELECT count(*) FROM t) AS duplicates_removed FROM f
    """,
)
def customer_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Global counters over the funnels of all sources, against the survivors' number."""
    li = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("source_id"), (F.col("l_quantity") > 10).cast("int").alias("entity_count"),
        (F.col("l_linestatus") == "O").alias("is_statewide"), (F.col("l_returnflag") == "A").alias("is_relevant"),
    )
    out = quality.summary(quality.source_funnel(li), _status_tenders(spark, folder))
    return out.select(
        "raw_records", "institution_matched", "medical_relevant", "false_positives_rejected", "unassigned_rejected", "duplicates_removed"
    )


@query_of(
    "order_priority_ranks",
    """
    SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN -1 WHEN o_orderkey % 3 = 0 THEN 3 WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0 END AS rank_value,
      CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE epoch_us(o_orderdate::TIMESTAMP) END AS published
    FROM orders
    """,
)
def order_priority_ranks(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    k = F.col("o_orderkey")
    groups = F.when(k % 3 == 0, F.array(F.lit("A"))).otherwise(F.array().cast("array<string>"))
    day = F.when(k % 5 == 0, "undated").otherwise(iso_day(F.col("o_orderdate")))
    rank = selection.priority_rank(F.col("o_orderstatus") != "F", groups, k % 2 == 0)
    return o.select(k.alias("k"), rank.alias("rank_value"), selection.published_rank(day).alias("published"))


@query_of(
    "line_document_order",
    """
    WITH d AS (SELECT l_orderkey AS notice_key, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 2 ELSE CASE WHEN l_linestatus = 'O' THEN 1 ELSE 3 END END AS kind FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY notice_key ORDER BY kind, l_linenumber, l_partkey, l_suppkey) AS position FROM d)
    SELECT notice_key, l_partkey, position::INT AS position FROM r WHERE position <= 4
    """,
)
def line_document_order(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as documents of an order: amendments, technical papers, price schedules, the rest; four at most."""
    li = table(spark, folder, "lineitem")
    kind = (
        F.when(F.col("l_returnflag") == "A", "corrigendum").when(F.col("l_returnflag") == "R", "boq")
        .when(F.col("l_linestatus") == "O", "technical-specification").otherwise("tender-document")
    )
    docs = li.select(
        F.col("l_orderkey").alias("notice_key"), "l_partkey", kind.alias("doc_type"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ordinal")
    )
    return selection.document_order(docs, 4).select("notice_key", "l_partkey", F.col("position").cast("int").alias("position"))


@query_of(
    "order_page_links",
    """
    SELECT l_orderkey AS page_id, 'https://a.gov.in/' || l_suppkey || '.pdf' AS doc_url,
      max_by('Line ' || l_linenumber || ' of ' || l_partkey, l_linenumber * 1000000 + l_partkey) AS label
    FROM lineitem GROUP BY l_orderkey, l_suppkey
    """,
)
def order_page_links(spark: SparkSession, folder: str) -> DataFrame:
    """Orders rendered as pages of links and read back: a repeated address keeps one row with its last label."""
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    anchor = F.concat(
        F.lit('<a href="/'), F.col("l_suppkey").cast("string"), F.lit('.pdf">Line '), F.col("l_linenumber").cast("string"),
        F.lit(" of "), F.col("l_partkey").cast("string"), F.lit("</a>\n"),
    )
    # an order has few lines by construction
    pages = spread(li, by="l_orderkey").groupBy(F.col("l_orderkey").alias("page_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", anchor.alias("a")))), lambda x: x["a"]), "").alias("html")
    ).withColumn("url", F.lit("https://a.gov.in/list"))
    return linked_documents(pages).select("page_id", "doc_url", "label")


@query_of(
    "event_last_of_kind",
    """
    WITH e AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
    SELECT user_id, event_type, min(i) AS i, max(event_id) AS event_id FROM e GROUP BY 1, 2
    """,
)
def event_last_of_kind(spark: SparkSession, folder: str) -> DataFrame:
    """The last event of each kind, at the place of the first."""
    e = table(spark, folder, "events").select("user_id", "event_type", "event_id")
    ranked = e.selectExpr("*", "cast(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS bigint) AS i")
    return last_rows(ranked, ["user_id", "event_type"], ["i"])


@query_of(
    "document_section_texts",
    r"""
    WITH d AS (SELECT doc_id, replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(1), '') AS t FROM documents),
    mixed AS (SELECT doc_id, CASE doc_id % 4
        WHEN 0 THEN t || chr(10) || 'Warranty:' || chr(10) || 'dropped' || chr(10) || 'Technical Specifications' || chr(10) || t
        WHEN 1 THEN 'Disclaimer' || chr(10) || t || chr(10) || 'Item specification' || chr(10) || t
        WHEN 2 THEN t || chr(10) || 'searched' || chr(10) || 'results here' || chr(10) || 'more'
        ELSE t || chr(10) || '3. Terms & Conditions' || chr(10) || t END AS t FROM d),
    l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM mixed),
    marked AS (SELECT *, CASE
        WHEN regexp_matches(line, '^(?:.*/\s*)?(?:technical|product|item)\s+specifications?\b', 'i') THEN 'T'
        WHEN regexp_matches(line, 'buyer added bid specific|consignees/reporting|general terms and conditions|additional terms and conditions', 'i')
          OR regexp_matches(line, '^\s*(?:\d+[.)]\s*)?(?:generic|help(?: centre| center)?|procurement history|bid history|terms (?:and|&) conditions|eligibility criteria|warranty|disclaimer)\s*:?\s*$', 'i')
          OR regexp_matches(line, 'GeMARPTS|searched\s+(?:strings|results?)|result generated|categories selected for notification', 'i') THEN 'A' END AS mark FROM l),
    sections AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM marked),
    kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS evidence FROM sections WHERE coalesce(section, 'T') = 'T' GROUP BY 1)
    SELECT doc_id, length(CASE WHEN t IS NOT NULL THEN coalesce(evidence, '') END) AS evidence_chars,
      sha256(CASE WHEN t IS NOT NULL THEN coalesce(evidence, '') END) AS evidence_sha256
    FROM d LEFT JOIN kept USING (doc_id)
    """,
)
def document_section_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents with sections mixed in, before, between and after their own lines; null texts stay null."""
    d = table(spark, folder, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    k = F.col("doc_id") % 4
    text = F.col("text")
    mixed = (
        F.when(k == 0, F.concat(text, F.lit("\nWarranty:\ndropped\nTechnical Specifications\n"), text))
        .when(k == 1, F.concat(F.lit("Disclaimer\n"), text, F.lit("\nItem specification\n"), text))
        .when(k == 2, F.concat(text, F.lit("\nsearched\nresults here\nmore")))
        .otherwise(F.concat(text, F.lit("\n3. Terms & Conditions\n"), text))
    )
    evidence = d.select("doc_id", product_evidence(mixed).alias("evidence"))
    return evidence.select(
        "doc_id", F.length("evidence").cast("bigint").alias("evidence_chars"), F.sha2("evidence", 256).alias("evidence_sha256")
    )


@query_of(
    "event_merge_step",
    """
    WITH e AS (SELECT user_id::VARCHAR AS s, event_type || '/' || (event_id % 10) AS identity, date_trunc('second', ts) AS ts, event_type, ts < TIMESTAMP '2024-01-16' AS early FROM events),
    old AS (SELECT s, identity, max(ts) AS ts FROM e WHERE early AND event_type <> 'error' GROUP BY 1, 2),
    new AS (SELECT s, identity, max(ts) AS ts FROM e WHERE NOT early AND event_type <> 'error' GROUP BY 1, 2),
    c AS (SELECT s, CASE WHEN s::INT % 4 = 0 THEN 'UNAVAILABLE' WHEN s::INT % 4 < 3 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status FROM e WHERE NOT early GROUP BY 1)
    SELECT s AS source_id, identity, ts AS observed_at, FALSE AS stale FROM new JOIN c USING (s) WHERE status <> 'UNAVAILABLE'
    UNION ALL SELECT s, identity, ts, FALSE FROM old WHERE s NOT IN (SELECT s FROM c)
    UNION ALL SELECT s, identity, ts, TRUE FROM old JOIN c USING (s) WHERE status = 'UNAVAILABLE'
    UNION ALL SELECT s, identity, ts, TRUE FROM old JOIN c USING (s) WHERE status = 'PARTIAL' AND s::INT % 2 = 0
      AND epoch_us(TIMESTAMP '2024-01-16 12:00:00') - epoch_us(ts) BETWEEN -300000000 AND 86400000000
      AND (s, identity) NOT IN (SELECT (s, identity) FROM new)
    """,
)
def event_merge_step(spark: SparkSession, folder: str) -> DataFrame:
    """One merge of a half's events into the state the first half left."""
    e = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("source_id"), F.concat_ws("/", "event_type", (F.col("event_id") % 10).cast("string")).alias("identity"),
        F.date_trunc("second", "ts").alias("ts"), "event_type", (F.col("ts") < F.lit("2024-01-16").cast("timestamp")).alias("early"),
    )

    def newest(rows: DataFrame) -> DataFrame:
        return rows.filter("event_type <> 'error'").groupBy("source_id", "identity").agg(F.max("ts").alias("observed_at"))

    state = newest(e.filter("early")).withColumn("stale", F.lit(False))
    late = e.filter("not early")
    k = F.col("source_id").cast("int") % 4
    control = late.select("source_id").distinct().withColumn(
        "status", F.when(k == 0, "UNAVAILABLE").when(k < 3, "PARTIAL").otherwise("SUCCESS")
    )
    out = snapshots.merge_step(state, control, newest(late), clock("2024-01-16 12:00:00"), F.expr(EVENT_INDEX))
    return out.select("source_id", "identity", "observed_at", "stale")


@query_of(
    "order_rotation_reaches_deferred",
    """
    WITH o AS (SELECT o_orderpriority AS source_id, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM orders)
    SELECT source_id, o_orderkey AS notice_key, CASE WHEN r <= 16 THEN 1 ELSE 2 END AS run FROM o WHERE r <= 32
    """,
)
def order_rotation_reaches_deferred(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs of the round robin: the second starts where the first stopped."""
    o = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("notice_key"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderpriority").alias("source_id"),
        F.array().cast("array<string>").alias("priority_categories"),
    )
    chunk = F.floor(F.col("ordinal") / 1000)
    first, cursors = selection.fair_rotation(o, chunk=chunk)
    second, _ = selection.fair_rotation(o, cursors=cursors, chunk=chunk)
    return first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2))).select("source_id", "notice_key", "run")
