"""Small builders shared by the tests."""

from pyspark.sql import functions as F

from noticemill.plans.dashboard import BRONZE
from noticemill.plans.tables import clock



def now(text="2026-09-30 12:00:00"):
    return clock(text)


def values(spark, inputs, fn, kind="string"):
    """Apply a column function to a list of inputs and return the results in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}").coalesce(1)
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


BASE = {
    "id": "n",
    "title": "Supply of ventilators",
    "source_id": "s1",
    "source_name": "Source one",
    "source_url": "https://a.gov.in/list",
    "tender_url": "https://a.gov.in/list",
    "publish_date": "2026-09-01",
    "original_closing_date": "2026-10-01",
    "verification": "listing",
    "fetched_at": "2026-09-30T11:00:00Z",
}


def notices(spark, *rows, **extra):
    """Bronze notices from partial dicts; ``extra`` adds (name, type) columns."""
    types = {**BRONZE, **extra}
    full = []
    for i, r in enumerate(rows):
        row = {c: None for c in types}
        row.update(BASE)
        row.update(r)
        full.append((i, i, *[row[c] for c in types]))
    ddl = "notice_key bigint, ordinal bigint, " + ", ".join(f"{c} {t}" for c, t in types.items())
    return spark.createDataFrame(full, ddl).coalesce(1)
