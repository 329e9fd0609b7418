"""Example queries on text tables: ingest, clean, classify, match and clauses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse_listing_date
from ..functions.deadlines import submission_deadline
from ..functions.identifiers import identity_key, surrogate_key
from ..functions.text import display_text, label_text, product_evidence
from ..functions.urls import host, path, query, scheme, without_session
from ..operators.classify import RuleBook, classify
from ..operators.entities import assign_entities, match_phrases, phrase_table, procurement_scope
from ..operators.quality import entity_records
from ..operators.requirements import (
    ClauseBook,
    clause_lines,
    document_description,
    extract_requirements,
    rule_hits,
)
from ..sources.html import scan_links
from .tables import spread, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query_of(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return keep


# --- ingest ------------------------------------------------------------------------


@query_of(
    "page_link_counts",
    """
    WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
    SELECT page_id, count(*) AS n_links, count(DISTINCT href) AS n_targets,
           count(*) FILTER (WHERE starts_with(href, '/')) AS n_rooted
    FROM l GROUP BY page_id
    """,
)
def page_link_counts(spark: SparkSession, folder: str) -> DataFrame:
    links = scan_links(spread(table(spark, folder, "pages").select("page_id", "html")))
    return links.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_links"),
        F.count_distinct("href").alias("n_targets"),
        F.count_if(F.startswith("href", F.lit("/"))).alias("n_rooted"),
    )


@query_of(
    "page_url_parts",
    r"""
    SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme,
           lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host,
           regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path,
           regexp_extract(url, '\?([^#]*)', 1) AS query_text,
           url AS public_url
    FROM pages
    """,
)
def page_url_parts(spark: SparkSession, folder: str) -> DataFrame:
    url = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id",
        scheme(url).alias("scheme"),
        host(url).alias("host"),
        path(url).alias("path"),
        query(url).alias("query_text"),
        without_session(url).alias("public_url"),
    )


# --- clean -------------------------------------------------------------------------

_DATE_TEXT = """
    CASE o_orderkey % 7
      WHEN 0 THEN strftime(o_orderdate, '%d-%m-%Y')
      WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') || ' 15:04'
      WHEN 2 THEN strftime(o_orderdate, '%d-%b-%Y') || ' 03:04 PM'
      WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d')
      WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T15:04:05Z'
      WHEN 5 THEN '31-Feb-' || strftime(o_orderdate, '%Y')
      ELSE 'NA' END
"""


def _rendered(orders: DataFrame):
    day = F.col("o_orderdate")
    k = F.col("o_orderkey") % 7
    return (
        F.when(k == 0, F.date_format(day, "dd-MM-yyyy"))
        .when(k == 1, F.concat(F.date_format(day, "dd/MM/yyyy"), F.lit(" 15:04")))
        .when(k == 2, F.concat(F.date_format(day, "dd-MMM-yyyy"), F.lit(" 03:04 PM")))
        .when(k == 3, F.date_format(day, "yyyy-MM-dd"))
        .when(k == 4, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T15:04:05Z")))
        .when(k == 5, F.concat(F.lit("31-Feb-"), F.date_format(day, "yyyy")))
        .otherwise("NA")
    )


# Listing dates before the year 2000 are rejected by rule, in both forms.
@query_of(
    "order_dates_parsed",
    """
    SELECT o_orderkey, CASE
      WHEN year(o_orderdate) < 2000 THEN NULL
      WHEN o_orderkey % 7 IN (0, 3) THEN strftime(o_orderdate, '%Y-%m-%d') || 'T23:59:59+05:30'
      WHEN o_orderkey % 7 IN (1, 2) THEN strftime(o_orderdate, '%Y-%m-%d') || 'T15:04:00+05:30'
      WHEN o_orderkey % 7 = 4 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T15:04:05Z' END AS parsed
    FROM orders
    """,
)
def order_dates_parsed(spark: SparkSession, folder: str) -> DataFrame:
    orders = spread(table(spark, folder, "orders").select("o_orderkey", "o_orderdate"))
    return orders.select("o_orderkey", parse_listing_date(_rendered(orders), True).alias("parsed"))


@query_of(
    "order_labelled_deadlines",
    """
    WITH d AS (
      SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS a,
             strftime(o_orderdate + INTERVAL 5 DAY, '%Y-%m-%d') AS b,
             year(o_orderdate) >= 2000 AS ok, year(o_orderdate + INTERVAL 5 DAY) >= 2000 AS ok2
      FROM orders)
    SELECT o_orderkey, CASE o_orderkey % 4
        WHEN 0 THEN CASE WHEN ok THEN a || 'T15:00:00+05:30' END
        WHEN 1 THEN CASE WHEN ok2 THEN b || 'T23:59:59+05:30' WHEN ok THEN a || 'T23:59:59+05:30' END
        WHEN 2 THEN CASE WHEN ok THEN NULL WHEN ok2 THEN b || 'T23:59:59+05:30' END END AS deadline,
      CASE o_orderkey % 4
        WHEN 0 THEN CASE WHEN ok THEN 'minute' END
        WHEN 1 THEN CASE WHEN ok OR ok2 THEN 'day' END
        WHEN 2 THEN CASE WHEN ok THEN NULL WHEN ok2 THEN 'day' END END AS date_precision
    FROM d
    """,
)
def order_labelled_deadlines(spark: SparkSession, folder: str) -> DataFrame:
    orders = spread(table(spark, folder, "orders").select("o_orderkey", "o_orderdate"))
    a = F.date_format("o_orderdate", "dd-MM-yyyy")
    b = F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 5 DAYS"), "dd-MM-yyyy")
    k = F.col("o_orderkey") % 4
    text = (
        F.when(k == 0, F.concat(F.lit("Bid End Date/Time: "), a, F.lit(" 03:00 PM")))
        .when(k == 1, F.concat(F.lit("Closing date: "), a, F.lit("\nRevised closing date: "), b))
        .when(k == 2, F.concat(F.lit("Due date "), a, F.lit("\nClosing date "), b))
        .otherwise(F.concat(F.lit("Warranty period end date: "), a))
    )
    found = orders.select("o_orderkey", submission_deadline(text).alias("d"))
    return found.select("o_orderkey", F.col("d.date").alias("deadline"), "d.date_precision")


@query_of(
    "order_surrogate_keys",
    """
    SELECT o_orderkey, substr(sha256('ORD|' || o_orderkey || '|' || o_orderpriority), 1, 20) AS id FROM orders
    """,
)
def order_surrogate_keys(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    identity = F.concat_ws("|", F.lit("ORD"), F.col("o_orderkey").cast("string"), "o_orderpriority")
    return orders.select("o_orderkey", surrogate_key(identity).alias("id"))


@query_of(
    "document_identity_keys",
    """
    SELECT md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS identity, count(*) AS copies, min(doc_id) AS first_doc
    FROM documents GROUP BY 1
    """,
)
def document_identity_keys(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.md5(identity_key(F.col("text"))).alias("identity"))
    return docs.groupBy("identity").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))


@query_of(
    "part_display_labels",
    """
    SELECT p_type, p_brand, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS type_label,
           count(*) AS parts FROM part GROUP BY p_type, p_brand
    """,
)
def part_display_labels(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("parts"))
    return parts.withColumn("type_label", display_text(label_text(F.col("p_type"))))


@query_of(
    "document_evidence",
    r"""
    SELECT doc_id, length(text) AS evidence_chars,
           length(trim(text, E' \n')) AS description_chars FROM documents
    """,
)
def document_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence and description text; plain prose has no sections, so nothing is dropped."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return docs.select(
        "doc_id",
        F.length(product_evidence(F.col("text"))).cast("bigint").alias("evidence_chars"),
        F.length(document_description(F.col("text"), 10_000_000)).cast("bigint").alias("description_chars"),
    )


# --- classify ----------------------------------------------------------------------

TOPICS = RuleBook(
    taxonomy=[
        ("LICENSING", r"\b(?:licen[cs]e\w*|released under)\b"),
        ("CONTACT", r"\b[a-z0-9._]+@[a-z0-9.]+\b"),
        ("PHONE", r"\b\d{3}-\d{4}\b"),
        ("ENGLISH", r"\b(?:the|and|of)\b"),
        ("GERMAN", r"\b(?:und|der|die)\b"),
        ("FRENCH", r"\b(?:les|des|une)\b"),
        ("SPANISH", r"\b(?:los|para|una)\b"),
    ],
    clean_text=False,
)
_TOPIC_SQL = ", ".join(f"len(regexp_extract_all(text, '{p}', 0, 'i')) AS h{i}" for i, (_, p) in enumerate(TOPICS.taxonomy))
_TOPIC_ROWS = " UNION ALL ".join(
    f"SELECT source, '{c}' AS category, h{i} AS hits, n FROM s WHERE h{i} > 0" for i, (c, _) in enumerate(TOPICS.taxonomy)
)
_TOPIC_N = " + ".join(f"(h{i} > 0)::INT" for i in range(len(TOPICS.taxonomy)))


@query_of(
    "document_topics",
    f"""
    WITH h AS (SELECT source, {_TOPIC_SQL} FROM documents), s AS (SELECT *, {_TOPIC_N} AS n FROM h)
    SELECT source, category, count(*) AS documents, sum(n) AS categories_in_documents,
           round(avg(least(0.98, 0.72 + n * 0.04)), 6) AS confidence
    FROM ({_TOPIC_ROWS}) GROUP BY source, category
    """,
)
def document_topics(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents").select("source", "text"))
    c = classify(docs, F.col("text"), book=TOPICS, out="c")
    rows = c.select("source", F.size("c.categories").alias("n"), "c.confidence", F.explode("c.categories").alias("category"))
    return rows.groupBy("source", "category").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("n").alias("categories_in_documents"),
        F.round(F.avg("confidence"), 6).alias("confidence"),
    )


@query_of(
    "document_source_funnel",
    f"""
    WITH h AS (SELECT doc_id, source, lang, {_TOPIC_SQL} FROM documents), s AS (SELECT *, {_TOPIC_N} AS n FROM h)
    SELECT s.source AS source_id, count(*) AS raw_records,
           count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS institution_matches,
           count(*) FILTER (WHERE (l.doc_id IS NOT NULL OR lang = 'en') AND n > 0) AS medical_matches,
           count(*) FILTER (WHERE (l.doc_id IS NOT NULL OR lang = 'en') AND n = 0) AS false_positives_rejected,
           count(*) FILTER (WHERE NOT (l.doc_id IS NOT NULL OR lang = 'en')) AS unassigned_rejected
    FROM s LEFT JOIN labels l ON l.doc_id = s.doc_id GROUP BY s.source
    """,
)
def document_source_funnel(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents count as attributed, English ones as statewide."""
    from ..operators.quality import source_funnel

    docs = spread(table(spark, folder, "documents").select("doc_id", "text", "lang", F.col("source").alias("source_id")))
    labelled = table(spark, folder, "labels").select("doc_id", F.lit(1).alias("labelled"))
    c = classify(docs, F.col("text"), book=TOPICS, out="c").drop("text").join(labelled, "doc_id", "left")
    return source_funnel(
        c.select(
            "source_id",
            F.coalesce("labelled", F.lit(0)).alias("entity_count"),
            (F.col("lang") == "en").alias("is_statewide"),
            F.col("c.is_relevant").alias("is_relevant"),
        )
    )


@query_of(
    "label_confusion",
    """
    WITH p AS (SELECT doc_id, regexp_matches(text, '\\b(?:the|and|of)\\b', 'i') AS predicted FROM documents)
    SELECT quality, predicted, count(*) AS documents FROM labels JOIN p USING (doc_id) GROUP BY quality, predicted
    """,
)
def label_confusion(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    c = classify(docs, F.col("text"), book=TOPICS, out="c")
    predicted = c.select("doc_id", F.array_contains("c.categories", "ENGLISH").alias("predicted"))
    return table(spark, folder, "labels").join(predicted, "doc_id").groupBy("quality", "predicted").agg(
        F.count(F.lit(1)).alias("documents")
    )


PARTS = RuleBook(
    taxonomy=[
        ("FASTENER", r"\b(?:bolt|ring|rod)\w*\b"),
        ("MACHINE", r"\b(?:gear|widget|gizmo)\w*\b"),
        ("PLATE", r"\bplates?\b"),
    ],
    non_product=r"\banvils?\b",
    portfolios=[
        {
            "brand": "North", "aliases": r"\bbrand#1\b", "models": r"\b(?:promo|economy)\b",
            "ambiguous_models": r"^promo$", "clinical_terms": None, "categories": ["FASTENER"],
            "evidence": {}, "exclusions": {}, "needs_clinical_term": [],
        },
        {
            "brand": "South", "aliases": r"\bbrand#2\b", "models": None, "ambiguous_models": None,
            "clinical_terms": r"\bhot\b", "categories": ["MACHINE", "PLATE"],
            "evidence": {"PLATE": r"\blarge\b"}, "exclusions": {"MACHINE": r"\bred\b"}, "needs_clinical_term": [],
        },
    ],
    clean_text=False,
)


@query_of(
    "part_brand_matches",
    r"""
    WITH t AS (SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type AS s FROM part),
    f AS (SELECT *, regexp_matches(s, '\b(?:bolt|ring|rod)\w*\b', 'i') AS fastener,
          regexp_matches(s, '\b(?:gear|widget|gizmo)\w*\b', 'i') AS machine, regexp_matches(s, '\bplates?\b', 'i') AS plate FROM t),
    g AS (SELECT *, fastener OR machine OR plate AS relevant FROM f),
    north AS (SELECT p_partkey, 'North' AS brand, CASE
        WHEN regexp_matches(s, '\bbrand#1\b', 'i') THEN 'explicit-brand'
        WHEN regexp_matches(s, '\beconomy\b', 'i') OR (regexp_matches(s, '\bpromo\b', 'i') AND fastener) THEN 'explicit-model'
        WHEN fastener THEN 'portfolio' END AS match_type FROM g WHERE relevant),
    south AS (SELECT p_partkey, 'South' AS brand, CASE
        WHEN regexp_matches(s, '\bbrand#2\b', 'i') THEN 'explicit-brand'
        WHEN (machine AND NOT regexp_matches(s, '\bred\b', 'i')) OR (plate AND regexp_matches(s, '\blarge\b', 'i'))
             OR regexp_matches(s, '\bhot\b', 'i') THEN 'portfolio' END AS match_type FROM g WHERE relevant)
    SELECT brand, match_type, count(*) AS parts, min(p_partkey) AS first_part
    FROM (SELECT * FROM north UNION ALL SELECT * FROM south) WHERE match_type IS NOT NULL GROUP BY brand, match_type
    """,
)
def part_brand_matches(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").withColumn("s", F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    c = classify(parts, F.col("s"), book=PARTS, out="c", brands=True)
    m = c.select("p_partkey", F.explode("c.brand_matches").alias("m"))
    return m.groupBy(F.col("m.brand").alias("brand"), F.col("m.match_type").alias("match_type")).agg(
        F.count(F.lit(1)).alias("parts"), F.min("p_partkey").alias("first_part")
    )


@query_of("medical_taxonomy_scan")
def medical_taxonomy_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The full medical rule book over whole document texts; its rules use look-ahead, which the oracle lacks."""
    docs = spread(table(spark, folder, "documents").select("source", "text"))
    c = classify(docs, F.col("text"), out="c", brands=True)
    return c.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if("c.is_relevant").alias("relevant"),
        F.sum(F.size("c.brand_matches")).alias("brand_matches"),
    )


# --- match entities ----------------------------------------------------------------

_KEY = "trim(regexp_replace(replace(lower({0}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


@query_of(
    "benchmark_passages",
    f"""
    WITH b AS (SELECT item_id, {_KEY.format('text')} AS phrase FROM benchmark),
         d AS (SELECT doc_id, ' ' || {_KEY.format('text')} || ' ' AS body FROM documents)
    SELECT doc_id, item_id FROM d JOIN b ON phrase <> '' AND contains(body, ' ' || phrase || ' ')
    """,
)
def benchmark_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that contain a benchmark passage on word boundaries."""
    passages = table(spark, folder, "benchmark").select(F.col("item_id").alias("id"), "text")
    phrases = phrase_table(passages, phrases=["text"], alias_col=None)
    texts = spread(table(spark, folder, "documents").select("doc_id", "text"))
    return match_phrases(texts, phrases, "doc_id").select("doc_id", F.col("entity_id").alias("item_id"))


def _nations(spark: SparkSession, folder: str) -> DataFrame:
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").cast("string").alias("id"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("Office of "), "n_name").alias("short_name"),
        F.col("r_name").alias("region"),
        F.array(F.concat_ws(" ", F.lit("Branch"), F.col("n_nationkey").cast("string"))).alias("aliases"),
        F.col("n_nationkey").cast("int").alias("ordinal"),
    )


def _supplier_notices(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as notices naming one office by name, by alias, explicitly, or not at all."""
    s = table(spark, folder, "supplier")
    k, nation = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    title = (
        F.when(k % 4 == 0, F.concat(F.lit("Delivery to NATION & "), nation))
        .when(k % 4 == 1, F.concat(F.lit("Supply, office of nation-"), nation, F.lit("; branch "), ((F.col("s_nationkey") + 1) % 25).cast("string")))
        .when(k % 4 == 2, F.lit("Supply of goods"))
        .otherwise(F.lit("Supply of goods nowhere"))
    )
    return s.select(
        k.alias("notice_key"),
        title.alias("title"),
        F.when(k % 4 == 2, nation).alias("institution_id"),
        F.lit(None).cast("string").alias("region"),
        F.lit("suppliers").alias("source_id"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("location"),
        "s_acctbal",
    )


@query_of(
    "supplier_offices",
    """
    WITH m AS (
      SELECT s_suppkey, CASE s_suppkey % 4 WHEN 1 THEN s_nationkey WHEN 2 THEN s_nationkey END AS a,
             CASE s_suppkey % 4 WHEN 1 THEN (s_nationkey + 1) % 25 END AS b FROM supplier),
    e AS (SELECT s_suppkey, a AS n FROM m WHERE a IS NOT NULL UNION ALL SELECT s_suppkey, b FROM m WHERE b IS NOT NULL)
    SELECT supplier.s_suppkey AS notice_key, CASE WHEN count(n) > 1 THEN 'multi-institution' WHEN count(n) = 1 THEN 'institution'
           ELSE 'statewide' END AS procurement_scope, count(n) AS entities, min(n)::INT AS first_entity
    FROM supplier LEFT JOIN e ON e.s_suppkey = supplier.s_suppkey GROUP BY supplier.s_suppkey
    """,
)
def supplier_offices(spark: SparkSession, folder: str) -> DataFrame:
    m = assign_entities(_supplier_notices(spark, folder), _nations(spark, folder))
    return m.select(
        "notice_key",
        procurement_scope(F.col("matched")).alias("procurement_scope"),
        F.size("matched").cast("bigint").alias("entities"),
        F.array_min(F.transform("matched", lambda e: e["id"].cast("int"))).alias("first_entity"),
    )


@query_of(
    "office_coverage",
    """
    WITH m AS (
      SELECT s_suppkey, s_acctbal, CASE s_suppkey % 4 WHEN 1 THEN s_nationkey WHEN 2 THEN s_nationkey END AS a,
             CASE s_suppkey % 4 WHEN 1 THEN (s_nationkey + 1) % 25 END AS b FROM supplier),
    e AS (SELECT s_acctbal, a AS n FROM m WHERE a IS NOT NULL UNION ALL SELECT s_acctbal, b FROM m WHERE b IS NOT NULL)
    SELECT n::VARCHAR AS entity_id, count(*) AS records, count(*) FILTER (WHERE s_acctbal > 0) AS relevant FROM e GROUP BY n
    """,
)
def office_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Raw records per entity: one attribution, many groups."""
    m = assign_entities(_supplier_notices(spark, folder), _nations(spark, folder))
    m = m.withColumn("is_relevant", F.col("s_acctbal") > 0)
    return entity_records(m).groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("records"), F.count_if("is_relevant").alias("relevant")
    )


# --- clauses -----------------------------------------------------------------------

PROSE_CLAUSES = ClauseBook(
    rules=(
        ("terms", "Licensing", r"\blicen[cs]e\w*\b"),
        ("technical", "Articles", r"\b(?:the|der|les|los)\b"),
        ("technical", "Conjunctions", r"\b(?:and|und|et)\b"),
        ("quantity", "Numbers", r"\b\d+\b"),
    ),
    amendment=r"\b(?:the|les)\b",
    technical_section="technical",
    named_by_match="",
)


def _document_pages(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text")).select(
        F.col("doc_id").alias("notice_key"),
        F.lit(0).alias("doc_ordinal"),
        F.lit(0).alias("page_ordinal"),
        F.lit(1).alias("page"),
        F.lit(None).cast("string").alias("sheet"),
        F.lit(None).cast("int").alias("row"),
        "text",
    )


@query_of(
    "document_clause_hits",
    r"""
    WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS raw FROM documents),
    n AS (SELECT doc_id, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS line FROM l),
    c AS (SELECT * FROM n WHERE length(line) >= 3 AND NOT regexp_matches(line, '^(?:page \d+|-- \d+ of \d+ --)$', 'i')),
    h AS (
      SELECT doc_id, line, 'terms' AS section, 'Licensing' AS field FROM c WHERE regexp_matches(line, '\blicen[cs]e\w*\b', 'i')
      UNION ALL SELECT doc_id, line, 'technical', 'Articles' FROM c WHERE regexp_matches(line, '\b(?:the|der|les|los)\b', 'i')
      UNION ALL SELECT doc_id, line, 'technical', 'Conjunctions' FROM c WHERE regexp_matches(line, '\b(?:and|und|et)\b', 'i')
      UNION ALL SELECT doc_id, line, 'quantity', 'Numbers' FROM c WHERE regexp_matches(line, '\b\d+\b', 'i'))
    SELECT section, field, count(*) AS lines, count(DISTINCT doc_id) AS documents, count(DISTINCT line) AS texts FROM h GROUP BY section, field
    """,
)
def document_clause_hits(spark: SparkSession, folder: str) -> DataFrame:
    lines = clause_lines(_document_pages(spark, folder), PROSE_CLAUSES).filter("not noise")
    hits = rule_hits(lines, PROSE_CLAUSES)
    return hits.groupBy("section", "field").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_distinct("notice_key").alias("documents"),
        F.count_distinct("text").alias("texts"),
    )


@query_of("conversation_clauses")
def conversation_clauses(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as documents: later turns amend earlier clauses. Order-dependent, so checked by brute force in tests."""
    turns = table(spark, folder, "conversations")
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("turn").cast("int")), "yyyy-MM-dd")
    documents = turns.select(
        F.col("conv_id").alias("notice_key"),
        F.col("turn").cast("int").alias("doc_ordinal"),
        F.concat_ws("/", F.lit("turn"), F.col("turn").cast("string")).alias("doc_url"),
        F.col("role").alias("label"),
        F.when(F.col("turn") > 0, "corrigendum").otherwise("technical-specification").alias("doc_type"),
        F.lit("parsed").alias("doc_status"),
        day.alias("published_date"),
        F.lit("text").alias("text_method"),
    )
    pages = turns.select(
        F.col("conv_id").alias("notice_key"), F.col("turn").cast("int").alias("doc_ordinal"), F.lit(0).alias("page_ordinal"),
        F.lit(1).alias("page"), F.lit(None).cast("string").alias("sheet"), F.lit(None).cast("int").alias("row"), "text",
    )
    r = extract_requirements(pages, documents, PROSE_CLAUSES)
    clauses = r.clauses.groupBy("notice_key").agg(F.count(F.lit(1)).alias("clauses"))
    replaced = r.superseded.groupBy("notice_key").agg(F.count(F.lit(1)).alias("superseded"))
    return (
        r.status.join(clauses, "notice_key", "left").join(replaced, "notice_key", "left").fillna(0, ["clauses", "superseded"])
    )
