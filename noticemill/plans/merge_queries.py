"""The ordered merge on orders as mirrored notices, with SQL that folds them one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import deduplicate
from .tables import clock, table

#: Orders that may mirror each other stand in runs of this many keys.
RUN = 32

# What an order says of itself; the same words in SQL and in Spark.
FIELDS = {
    "id": f"concat('i', b, '-', k * 7 % 5)",
    "tender_id": "CASE WHEN k % 11 = 0 THEN concat('GEM/2026/B/', b * 4 + k % 2) WHEN k % 13 = 1 THEN concat('2026_PGIME_', b, '_', k % 2) "
    "WHEN k % 13 = 2 THEN NULL WHEN k % 4 = 0 THEN concat(' T', b, '-', k % 3) END",
    "source_id": "CASE WHEN k % 11 = 0 THEN 'gem-direct-x' WHEN k % 13 = 1 THEN 'cppp-pgimer' WHEN k % 13 = 2 THEN 'pgimer-notices' ELSE concat('s', k % 3) END",
    "institution_id": "CASE WHEN k % 11 > 0 AND k % 13 IN (1, 2) THEN 'pgimer' END",
    "organisation": "CASE WHEN k % 6 <> 5 THEN concat('Org ', b, '-', k % 2) END",
    "title": "CASE WHEN k % 3 = 1 THEN 'Supply of beds' WHEN k % 3 = 2 THEN 'supply, of beds!' ELSE 'Lamps' END",
    "tender_url": "CASE WHEN k % 5 = 0 THEN concat('https://a.gov.in/', b, '-', k % 4, '.pdf') ELSE 'https://a.gov.in/list' END",
    "reference_number": "CASE WHEN k % 11 > 0 AND k % 13 IN (1, 2) THEN concat('PI(EP)/25-26/G/', b, '/', k % 2) WHEN k % 17 = 0 THEN '--' "
    "WHEN k % 3 = 0 THEN concat('R/', b, '-', k % 2) END",
    "publish_date": "CASE WHEN k % 7 <> 0 THEN concat('2026-09-0', 1 + k % 2) END",
    "status": "CASE WHEN k % 23 = 0 THEN 'CANCELLED' ELSE 'ACTIVE_LIKELY' END",
    "verification": "CASE WHEN k % 9 < 4 THEN 'detail' ELSE 'listing' END",
    "fetched_at": "concat('2026-09-30T0', k * 5 % 4, ':00:00Z')",
    "extended_closing_date": "CASE WHEN k % 2 = 0 THEN '2026-10-09' END",
    "effective_closing_date": "CASE WHEN k % 2 = 1 THEN '2026-10-09' END",
    "description": "CASE WHEN k % 5 = 2 THEN concat('d', k) END",
}
STALE = "k % 10 < 3"
# Numbers of the documents and amendments of an order; a document may be listed twice.
DOCUMENTS = "CASE WHEN k % 4 = 1 THEN {list}(k % 3, k % 2) WHEN k % 4 = 2 THEN {list}(k % 2, k % 2) END"
AMENDMENTS = "CASE WHEN k % 8 = 3 THEN {list}(k % 3) END"

_SAME = """
    CASE WHEN s.t IS NOT NULL AND r.t IS NOT NULL THEN s.t = r.t
         WHEN s.id = r.id THEN TRUE
         WHEN s.auth <> r.auth THEN FALSE
         WHEN ((s.role = 'p' AND r.role = 'm') OR (s.role = 'm' AND r.role = 'p')) AND s.item = r.item AND s.title = r.title THEN TRUE
         WHEN s.day <> r.day THEN FALSE
         WHEN s.title = r.title AND s.url = r.url THEN TRUE
         WHEN s.ref = r.ref AND s.auth IS NOT NULL AND r.auth IS NOT NULL
           THEN s.title = r.title AND (len(s.docs) = 0 OR len(r.docs) = 0 OR s.docs = r.docs)
         ELSE FALSE END"""
_QUALITY = "10 * {0}.detail + len({0}.docs) + len({0}.cors) + ({0}.descr IS NOT NULL)::INT"
_WINS = f"""
    CASE WHEN r.ended <> s.ended THEN r.ended
         WHEN (r.idx OR s.idx) AND r.stale <> s.stale THEN NOT r.stale
         WHEN ((s.role = 'p' AND r.role = 'm') OR (s.role = 'm' AND r.role = 'p')) AND s.item = r.item AND s.title = r.title
              AND r.fp <> s.fp THEN r.fp
         WHEN r.fi <> s.fi THEN r.fi
         ELSE r.obs > s.obs OR (r.obs = s.obs AND {_QUALITY.format('r')} > {_QUALITY.format('s')}) END"""
_OWN = "k id t auth role item day title url ref ended stale idx fi fp obs detail".split()
_MERGED = ", ".join(
    [f"'{c}': CASE WHEN won THEN r.{c} ELSE s.{c} END" for c in _OWN]
    + ["'docs': list_sort(list_distinct(list_concat(s.docs, r.docs)))", "'cors': list_distinct(list_concat(s.cors, r.cors))"]
    + ["'descr': CASE WHEN won THEN coalesce(r.descr, s.descr) ELSE coalesce(s.descr, r.descr) END"]
    + ["'members': list_concat(s.members, r.members)"]
)

ORDER_MIRRORS = f"""
WITH RECURSIVE o AS (SELECT o_orderkey AS k, o_orderkey // {RUN} AS b FROM orders),
f AS (SELECT k, b, {", ".join(f"{e} AS {c}" for c, e in FIELDS.items())}, {STALE} AS stale,
        {DOCUMENTS.format(list="list_value")} AS docs, {AMENDMENTS.format(list="list_value")} AS cors FROM o),
g AS (SELECT *, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS nt,
        nullif(regexp_replace(lower(coalesce(institution_id, organisation)), '[^a-z0-9]', '', 'g'), '') AS auth FROM f),
rec AS (SELECT b, row_number() OVER (PARTITION BY b ORDER BY k) AS i, {{
    'k': k, 'id': id, 't': lower(trim(tender_id)), 'auth': auth,
    'role': CASE WHEN source_id = 'cppp-pgimer' THEN 'p' WHEN source_id = 'pgimer-notices' THEN 'm' END,
    'item': CASE WHEN institution_id = 'pgimer' THEN reference_number END, 'day': substr(publish_date, 1, 10), 'title': nt,
    'url': CASE WHEN tender_url LIKE '%.pdf' THEN tender_url END,
    'ref': regexp_replace(lower(reference_number), '[^a-z0-9]', '', 'g'), 'ended': status = 'CANCELLED', 'stale': stale,
    'idx': source_id = 'gem-direct-x', 'fi': source_id = 'gem-direct-x' AND NOT stale AND extended_closing_date IS NOT NULL,
    'fp': source_id = 'cppp-pgimer' AND verification = 'detail' AND NOT stale AND effective_closing_date IS NOT NULL,
    'obs': fetched_at, 'detail': (verification = 'detail')::INT, 'docs': list_sort(coalesce(docs, [])), 'cors': coalesce(cors, []),
    'descr': description, 'members': [k]}} AS r FROM g),
fold AS (
  SELECT b, i, [r] AS kept FROM rec WHERE i = 1
  UNION ALL
  SELECT b, i, CASE WHEN coalesce(place, 0) = 0 THEN list_append(kept, r)
      ELSE list_concat(list_concat(kept[1:place - 1], [{{{_MERGED}}}]), kept[place + 1:]) END
  FROM (SELECT *, {_WINS} AS won FROM (SELECT *, kept[place] AS s
        FROM (SELECT fold.b, rec.i, kept, r, list_position(list_transform(kept, lambda s: {_SAME}), TRUE) AS place
              FROM fold JOIN rec ON rec.b = fold.b AND rec.i = fold.i + 1)))
),
done AS (SELECT unnest(kept) AS s FROM (SELECT kept FROM fold QUALIFY row_number() OVER (PARTITION BY b ORDER BY i DESC) = 1))
SELECT s.k AS survivor, array_to_string(list_sort(s.members), ',') AS members, s.descr AS description,
  array_to_string(list_sort(list_distinct(s.docs)), ',') AS documents, len(list_distinct(s.cors)) AS n_amendments
FROM done
"""


def order_mirror_notices(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as notices that share ids, references, addresses and days in runs of neighbouring keys."""
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), F.expr(f"o_orderkey div {RUN}").alias("b"))
    rows = o.selectExpr("k AS notice_key", "k AS ordinal", *[f"{e} AS {c}" for c, e in FIELDS.items()], f"{STALE} AS stale",
                        f"{DOCUMENTS.format(list='array')} AS d", f"{AMENDMENTS.format(list='array')} AS c")
    document = lambda n: F.struct(F.lit("file").alias("label"), n.cast("string").alias("url"))
    none = F.lit(None).cast("string")
    amendment = lambda n: F.struct(F.lit("Extension").alias("title"), none.alias("type"), none.alias("published_date"),
                                   none.alias("revised_closing_date"), n.cast("string").alias("url"))
    return rows.withColumns({"documents": F.transform("d", document), "corrigenda": F.transform("c", amendment)}).drop("d", "c")


def order_mirrors(spark: SparkSession, folder: str) -> DataFrame:
    """Survivors of the ordered merge with their members, what they filled in and the documents they gathered."""
    merged = deduplicate(order_mirror_notices(spark, folder), clock("2026-09-30 12:00:00"))

    def listed(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
        # A survivor has at most a run's members, and a few documents.
        return rows.groupBy(F.col(key).alias("survivor")).agg(F.array_join(F.array_sort(F.collect_list(value)), ",").alias(out))

    members = listed(merged.members, "survivor_key", "notice_key", "members")
    documents = listed(merged.documents, "notice_key", "url", "documents")
    amendments = merged.amendments.groupBy(F.col("notice_key").alias("survivor")).agg(F.count(F.lit(1)).alias("n_amendments"))
    return (
        merged.survivors.select(F.col("notice_key").alias("survivor"), "description")
        .join(members, "survivor")
        .join(documents, "survivor", "left")
        .join(amendments, "survivor", "left")
        .select("survivor", "members", "description", F.coalesce("documents", F.lit("")).alias("documents"),
                F.coalesce("n_amendments", F.lit(0)).alias("n_amendments"))
    )


QUERIES = {"order_mirrors": order_mirrors}
ORACLE = {"order_mirrors": ORDER_MIRRORS}
