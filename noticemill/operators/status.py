"""Status, effective deadline and the deadline evidence rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import (
    bare_day,
    deadline_instant,
    instant,
    local_day_number,
    within,
)
from ..functions.identifiers import present
from ..functions.patterns import matches

# Amendment wording that ends a notice, and the observation window.
WITHDRAWN_WORDS = r"\b(?:withdrawn|withdrawal|withdraw)\b"
CANCELLED_WORDS = r"\b(?:cancelled|canceled|cancellation|cancel)\b"
FRESH_SECONDS, AHEAD_SECONDS = 86_400, 300
ACTIVE = ["ACTIVE_VERIFIED", "ACTIVE_LIKELY"]
TERMINAL = ["CANCELLED", "WITHDRAWN"]

_EARLIEST = "0001-01-01 00:00:00"


def _wording(title: Column, kind: Column) -> Column:
    text = F.concat_ws(" ", F.coalesce(kind, F.lit("")), F.coalesce(title, F.lit("")))
    return F.when(matches(text, WITHDRAWN_WORDS), "WITHDRAWN").when(matches(text, CANCELLED_WORDS), "CANCELLED")


def amendment_outcome(amendments: DataFrame, key: str = "notice_key") -> DataFrame:
    """Per notice, the last ending words and the last readable revised date.

    Input is the long table (key, ordinal, title, type, published_date,
    revised_closing_date).  Missing publication dates sort first, ties by ordinal.
    Both picks are ordered aggregates, combined map-side.
    """
    at = F.struct(
        F.coalesce(instant(F.col("published_date")), F.lit(_EARLIEST).cast("timestamp")).alias("at"),
        F.col("ordinal"),
    )
    rows = amendments.select(
        key,
        at.alias("__at"),
        _wording(F.col("title"), F.col("type")).alias("__ends"),
        F.when(instant(F.col("revised_closing_date")).isNotNull(), F.col("revised_closing_date")).alias("__revised"),
    )
    return rows.groupBy(key).agg(
        F.max_by("__ends", F.when(F.col("__ends").isNotNull(), F.col("__at"))).alias("amendment_end"),
        F.max_by("__revised", F.when(F.col("__revised").isNotNull(), F.col("__at"))).alias("amendment_deadline"),
    )


def _from_array(pick: str) -> Column:
    """Same picks over an embedded amendment array."""
    items = F.coalesce(
        F.col("corrigenda"),
        F.expr(
            "cast(array() as array<struct<title:string,type:string,published_date:string,"
            "revised_closing_date:string,url:string>>)"
        ),
    )

    def keyed(c: Column, i: Column) -> Column:
        value = (
            _wording(c["title"], c["type"])
            if pick == "end"
            else F.when(instant(c["revised_closing_date"]).isNotNull(), c["revised_closing_date"])
        )
        return F.struct(
            F.coalesce(instant(c["published_date"]), F.lit(_EARLIEST).cast("timestamp")).alias("at"),
            i.alias("i"),
            value.alias("v"),
        )

    return F.array_max(F.filter(F.transform(items, keyed), lambda x: x["v"].isNotNull()))["v"]


def _bool(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)


def _string(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def resolve_status(
    notices: DataFrame,
    now: Column,
    amendments: DataFrame | None = None,
    key: str = "notice_key",
    verification: Column | None = None,
) -> DataFrame:
    """Add ``status`` and ``effective_closing_date``.

    Amendments come from a long table, or from the ``corrigenda`` array when no
    table is given.
    """
    if amendments is not None:
        work = notices.join(amendment_outcome(amendments, key), key, "left")
    else:
        nested = "corrigenda" in notices.columns
        none = F.lit(None).cast("string")
        work = notices.withColumns(
            {
                "amendment_end": _from_array("end") if nested else none,
                "amendment_deadline": _from_array("deadline") if nested else none,
            }
        )

    def readable(name: str) -> Column:
        value = _string(work, name)
        return F.when(instant(value).isNotNull(), value)

    base_end = F.when(_bool(work, "withdrawn"), "WITHDRAWN").when(_bool(work, "cancelled"), "CANCELLED")
    work = work.withColumns(
        {
            "effective_closing_date": F.coalesce(
                F.col("amendment_deadline"), readable("extended_closing_date"), readable("original_closing_date")
            ),
            "__end": F.coalesce(F.col("amendment_end"), base_end),
        }
    )
    effective = F.col("effective_closing_date")
    checked = _string(work, "verification") if verification is None else verification
    fresh = within(instant(_string(work, "fetched_at")), now, FRESH_SECONDS, AHEAD_SECONDS)
    verified = (
        F.coalesce(checked == "detail", F.lit(False))
        & fresh
        & ~F.coalesce(_string(work, "date_precision") == "day", F.lit(False))
        & ~bare_day(effective)
    )
    status = (
        F.when(F.col("__end").isNotNull(), F.col("__end"))
        .when(effective.isNull(), "DEADLINE_UNKNOWN")
        .when(deadline_instant(effective) < now, "EXPIRED")
        .when(verified, "ACTIVE_VERIFIED")
        .otherwise("ACTIVE_LIKELY")
    )
    return work.withColumn("status", status).drop("__end", "amendment_end", "amendment_deadline")


def read_verification(verification: Column, stale: Column, fetched_at: Column, now: Column) -> Column:
    """Detail checks only count on the local day they were made and when not stale."""
    fetched = instant(fetched_at)
    same_day = F.coalesce(local_day_number(fetched) == local_day_number(now), F.lit(False))
    return F.when(F.coalesce(stale, F.lit(False)) | ~same_day, F.lit("listing")).otherwise(verification)


def refresh_elapsed(tenders: DataFrame, now: Column) -> DataFrame:
    """Expire or downgrade active rows at the read clock; other rows are unchanged."""
    fetched = instant(F.col("fetched_at"))
    fresh = (
        within(fetched, now, FRESH_SECONDS, AHEAD_SECONDS)
        & ~_bool(tenders, "stale")
        & ~F.coalesce(_string(tenders, "date_precision") == "day", F.lit(False))
        & ~bare_day(F.col("effective_closing_date"))
        & F.coalesce(local_day_number(fetched) == local_day_number(now), F.lit(False))
    )
    active = F.col("status").isin(ACTIVE)
    elapsed = F.coalesce(deadline_instant(F.col("effective_closing_date")) < now, F.lit(False))
    return tenders.withColumn(
        "status",
        F.when(active & elapsed, "EXPIRED")
        .when((F.col("status") == "ACTIVE_VERIFIED") & ~fresh, "ACTIVE_LIKELY")
        .otherwise(F.col("status")),
    )


def current_candidate(df: DataFrame, now: Column) -> Column:
    """Not ended and still open; an undated notice must be recently published.

    Needs the columns of ``resolve_status``.
    """
    close = F.col("effective_closing_date")
    shown = F.when(_string(df, "date_precision") == "day", F.left(close, F.lit(10))).otherwise(close)
    declared = F.coalesce(
        present(_string(df, "extended_closing_date")), present(_string(df, "original_closing_date"))
    ).isNotNull()
    published = instant(_string(df, "publish_date"))
    recent = within(published, now, 180 * 86_400, 86_400)
    return F.coalesce(
        F.when(F.col("status").isin(TERMINAL), False)
        .when(close.isNotNull(), deadline_instant(shown) >= now)
        .when(declared, False)
        .otherwise(recent),
        F.lit(False),
    )


# --- deadline evidence -----------------------------------------------------------


def latest_amendment_deadline(documents: DataFrame, key: str = "notice_key") -> DataFrame:
    """(key, date, date_precision) from amendment documents.

    Needs ``doc_type``, ``doc_status``, ``published_date``, ``has_label`` and
    ``deadline`` (struct).  The deciding set is every undated amendment plus those of
    the latest publication; any unreadable or two different instants give no row.
    """
    rows = documents.filter(
        (F.col("doc_type") == "corrigendum") & (F.col("doc_status") == "parsed") & F.col("has_label")
    ).select(key, instant(F.col("published_date")).alias("__at"), "deadline")
    latest = rows.groupBy(key).agg(F.max("__at").alias("__last"))
    deciding = rows.join(latest, key).filter(F.col("__at").isNull() | (F.col("__at") == F.col("__last")))
    at = instant(F.col("deadline.date"))
    return (
        deciding.groupBy(key)
        .agg(
            F.min(at).alias("__lo"),
            F.max(at).alias("__hi"),
            F.max(F.col("deadline").isNull()).alias("__bad"),
            F.min("deadline").alias("d"),
        )
        .filter(~F.col("__bad") & (F.col("__lo") == F.col("__hi")))
        .select(key, F.col("d.date").alias("date"), F.col("d.date_precision").alias("date_precision"))
    )


def apply_amendment_deadline(
    notices: DataFrame, deadlines: DataFrame, index_source: Column, key: str = "notice_key"
) -> DataFrame:
    """Set the extended date from amendments, except where the listing is a live index."""
    d = deadlines.select(key, F.col("date").alias("__date"), F.col("date_precision").alias("__precision"))
    work = notices.join(d, key, "left")
    published = present(F.col("publish_date"))
    usable = (
        F.col("__date").isNotNull()
        & ~index_source
        & (published.isNull() | F.coalesce(instant(F.col("__date")) >= instant(published), F.lit(False)))
    )
    return work.withColumns(
        {
            "extended_closing_date": F.when(usable, F.col("__date")).otherwise(F.col("extended_closing_date")),
            "date_precision": F.when(usable, F.col("__precision")).otherwise(F.col("date_precision")),
            "verification": F.when(usable, "listing").otherwise(F.col("verification")),
        }
    ).drop("__date", "__precision")


def single_document_deadline(documents: DataFrame, key: str = "notice_key") -> DataFrame:
    """(key, date, date_precision) when all parsed non-amendment documents state one date."""
    rows = documents.filter(
        (F.col("doc_type") != "corrigendum") & (F.col("doc_status") == "parsed") & F.col("deadline").isNotNull()
    )
    return (
        rows.groupBy(key)
        .agg(F.min("deadline").alias("d"), F.min("deadline.date").alias("lo"), F.max("deadline.date").alias("hi"))
        .filter("lo = hi")
        .select(key, F.col("d.date").alias("date"), F.col("d.date_precision").alias("date_precision"))
    )


# Notes that block an inferred deadline.
CONFLICT_NOTE = r"conflict|deadlines differ|deadline.*unknown pending"


def apply_document_deadline(
    notices: DataFrame, deadlines: DataFrame, index_source: Column, key: str = "notice_key"
) -> DataFrame:
    """Fill a missing closing date from documents unless a conflict was noted."""
    d = deadlines.select(key, F.col("date").alias("__date"), F.col("date_precision").alias("__precision"))
    work = notices.join(d, key, "left")
    conflict = F.coalesce(F.exists("notes", lambda n: matches(n, CONFLICT_NOTE)), F.lit(False))
    published = present(F.col("publish_date"))
    usable = (
        F.col("__date").isNotNull()
        & ~index_source
        & present(F.col("original_closing_date")).isNull()
        & present(F.col("extended_closing_date")).isNull()
        & ~conflict
        & (published.isNull() | F.coalesce(instant(F.col("__date")) >= instant(published), F.lit(False)))
    )
    return work.withColumns(
        {
            "original_closing_date": F.when(usable, F.col("__date")).otherwise(F.col("original_closing_date")),
            "date_precision": F.when(usable, F.col("__precision")).otherwise(F.col("date_precision")),
            "verification": F.when(usable, "listing").otherwise(F.col("verification")),
        }
    ).drop("__date", "__precision")


DIFFERENT_DEADLINES = "deadline-differs-between-listing-and-document"


def reconcile_listing_deadline(
    notices: DataFrame, deadlines: DataFrame, key: str = "notice_key"
) -> DataFrame:
    """Listing against document: same day takes the document's time, another day gives NULL and a note."""
    d = deadlines.select(key, F.col("date").alias("__date"), F.col("date_precision").alias("__precision"))
    work = notices.join(d, key, "left")
    published, listed = present(F.col("publish_date")), present(F.col("original_closing_date"))
    usable = F.col("__date").isNotNull() & (
        published.isNull() | F.coalesce(instant(F.col("__date")) >= instant(published), F.lit(False))
    )
    same = listed.isNull() | (F.left(listed, F.lit(10)) == F.left("__date", F.lit(10)))
    notes = F.coalesce(F.col("notes"), F.array().cast("array<string>"))
    return work.withColumns(
        {
            "original_closing_date": F.when(usable & same, F.col("__date")).when(usable, F.lit(None)).otherwise(
                F.col("original_closing_date")
            ),
            "date_precision": F.when(usable & same, F.col("__precision")).otherwise(F.col("date_precision")),
            "notes": F.when(usable & ~same, F.concat(notes, F.array(F.lit(DIFFERENT_DEADLINES)))).otherwise(notes),
            "verification": F.when(F.col("__date").isNotNull(), "listing").otherwise(F.col("verification")),
        }
    ).drop("__date", "__precision")


def running_extension(amendments: DataFrame, key: str = "notice_key", single: bool = True) -> DataFrame:
    """(key, extended_closing_date): amendments apply in listed order when not older than the last applied.

    Because an amendment only applies at or after the latest applied publication,
    the result is the revision with the greatest (published, ordinal).
    """
    rows = amendments.filter(present(F.col("revised_closing_date")).isNotNull()).withColumn(
        "__at", instant(F.col("published_date"))
    )
    out = rows.groupBy(key).agg(
        F.max_by("revised_closing_date", F.when(F.col("__at").isNotNull(), F.struct("__at", "ordinal"))).alias("dated"),
        F.max("revised_closing_date").alias("only"),
    )
    total = amendments.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    fallback = F.when(F.col("n") == 1, F.col("only")) if single else F.lit(None)
    return out.join(total, key).select(key, F.coalesce("dated", fallback).alias("extended_closing_date"))


def latest_amendment(amendments: DataFrame, key: str = "notice_key") -> DataFrame:
    """The newest amendment per notice; the later listed one wins a tie."""
    at = F.struct(
        F.coalesce(instant(F.col("published_date")), F.lit(_EARLIEST).cast("timestamp")), F.col("ordinal")
    )
    rest = F.struct(*[F.col(c) for c in amendments.columns if c != key])
    return amendments.groupBy(key).agg(F.max_by(rest, at).alias("r")).select(key, "r.*")


def apply_corrections(
    documents: DataFrame, corrections: DataFrame, url: str = "url", digest: str = "sha256"
) -> DataFrame:
    """Reviewed corrections, joined only on the exact (url, digest) pair."""
    cols = [c for c in corrections.columns if c not in (url, digest)]
    reviewed = corrections.select(url, digest, *[F.col(c).alias(f"reviewed_{c}") for c in cols])
    return documents.join(reviewed, [url, digest], "left")


def upgrade_reviewed_time(notices: DataFrame, reviewed: DataFrame, key: str = "notice_key") -> DataFrame:
    """Give a day-precision date the reviewed clock time when the day agrees and nothing extends it."""
    r = reviewed.select(key, F.col("date").alias("__date"), F.col("date_precision").alias("__precision"))
    work = notices.join(r, key, "left")
    usable = (
        (F.col("date_precision") == "day")
        & present(F.col("extended_closing_date")).isNull()
        & (F.left("original_closing_date", F.lit(10)) == F.left("__date", F.lit(10)))
    )
    usable = F.coalesce(usable, F.lit(False))
    return work.withColumns(
        {
            "original_closing_date": F.when(usable, F.col("__date")).otherwise(F.col("original_closing_date")),
            "date_precision": F.when(usable, F.col("__precision")).otherwise(F.col("date_precision")),
            "verification": F.when(usable, "listing").otherwise(F.col("verification")),
        }
    ).drop("__date", "__precision")


def guard_known_conflicts(notices: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Null the closing date of notices whose (document name, publish day, listed day) is a known conflict."""
    names = F.transform(
        F.coalesce(F.col("documents"), F.array().cast("array<struct<label:string,url:string>>")),
        lambda d: F.try_url_decode(F.regexp_extract(d["url"], r"([^/?#]+)(?:[?#].*)?$", 1)),
    )
    work = notices.withColumn("__name", F.explode_outer(names))
    c = conflicts.select(
        F.col("document_name").alias("__name"),
        F.col("published").alias("__pub"),
        F.col("listed").alias("__listed"),
        F.col("bid").alias("__bid"),
    )
    hit = work.join(
        c,
        (work["__name"] == c["__name"])
        & (F.left("publish_date", F.lit(10)) == F.col("__pub"))
        & (F.left("original_closing_date", F.lit(10)) == F.col("__listed"))
        & F.col("extended_closing_date").isNull(),
        "left_semi",
    ).select("notice_key").distinct().withColumn("__conflict", F.lit(True))
    flagged = notices.join(hit, "notice_key", "left")
    return flagged.withColumn(
        "original_closing_date", F.when(F.col("__conflict"), F.lit(None)).otherwise(F.col("original_closing_date"))
    ).withColumn("deadline_conflict", F.coalesce(F.col("__conflict"), F.lit(False))).drop("__conflict")
