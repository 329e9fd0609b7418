"""Bounded selections that stay fair across groups, and rotation plans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import instant
from ..plans.lineage import cut
from ..sources import medical_rules as rules
from .entities import REGIONS, regional_health_department
from .ranking import chunked_row_number, top_per_group

INSPECTION_LIMIT = 16
UNGROUPED = "GENERIC"


def priority_rank(current: Column, groups: Column, generic: Column) -> Column:
    """-1 not current, 3 priority, 2 generic, 0 otherwise."""
    return F.when(~current, -1).when(F.size(groups) > 0, 3).when(generic, 2).otherwise(0)


def published_rank(publish_date: Column) -> Column:
    """Publication as seconds; missing dates count as 1970."""
    return F.coalesce(F.unix_micros(instant(publish_date)), F.lit(0))


def capped_candidates(
    df: DataFrame, caps: dict[str, int], default: int, source: str = "source_id", ordinal: str = "ordinal"
) -> DataFrame:
    """Best candidates per source: rank, then publication, then input order."""
    order = [F.desc("rank_value"), F.desc("published"), F.asc(ordinal)]
    cap = F.lit(default)
    for name, n in caps.items():
        cap = F.when(F.col(source) == name, n).otherwise(cap)
    top = top_per_group(df, [source], order, max([default, *caps.values()]), "position")
    return top.filter(F.col("position") <= cap)


def dynamic_cap(
    df: DataFrame, base: int = 20, ceiling: int = 128, source: str = "source_id", ordinal: str = "ordinal"
) -> DataFrame:
    """Per source min(ceiling, max(base, current priority rows)) candidates by rank.

    The priority count is a map-side aggregate; the row number never exceeds the ceiling.
    """
    counts = df.groupBy(source).agg(F.count_if(F.col("rank_value") >= 2).alias("__priority"))
    top = top_per_group(df, [source], [F.desc("rank_value"), F.asc(ordinal)], ceiling, "position")
    limit = F.least(F.lit(ceiling), F.greatest(F.lit(base), F.col("__priority")))
    return top.join(counts, source).filter(F.col("position") <= limit).drop("__priority")


def fair_selection(candidates: DataFrame, limit: int = INSPECTION_LIMIT, **more) -> DataFrame:
    """(source, key, position, grp): see ``fair_rotation``, without the next cursors."""
    source, key = more.get("source", "source_id"), more.get("key", "notice_key")
    return _replayed(candidates, limit, **more).filter("position > 0").select(source, key, "position", "grp")


def fair_rotation(candidates: DataFrame, limit: int = INSPECTION_LIMIT, **more) -> tuple[DataFrame, DataFrame]:
    """Round-robin choice of ``limit`` rows per source over its groups, and where each queue starts next time.

    Returns (source, key, position, grp) and (source, grp, next).  A queue moves on by the rows it has looked at:
    those it gave and those another group had taken before.  Feeding the second table to the next run as ``cursors``
    reaches the rows this run deferred.
    """
    source, key = more.get("source", "source_id"), more.get("key", "notice_key")
    both = cut(_replayed(candidates, limit, **more))
    return (
        both.filter("position > 0").select(source, key, "position", "grp"),
        both.filter("position = 0").select(source, "grp", "next"),
    )


def _replayed(
    candidates: DataFrame,
    limit: int = INSPECTION_LIMIT,
    cursors: DataFrame | None = None,
    source: str = "source_id",
    key: str = "notice_key",
    groups: str = "priority_categories",
    ordinal: str = "ordinal",
    chunk: Column | None = None,
) -> DataFrame:
    """Selected rows with their position from 1, and a row of position 0 for each queue with its next start.

    Rows may belong to several groups; each pass takes one untaken row per group, in
    order of each group's first row.  ``cursors`` (source, grp, next) rotates each
    group's queue.  At most ``limit`` rows are ever taken, so only the first
    ``2 * limit`` rows of each rotated queue can matter: they are found by distributed
    ranking, and the replay sees that many rows per group whatever the source's size.
    """
    named = F.when(F.size(groups) > 0, F.col(groups)).otherwise(F.array(F.lit(UNGROUPED)))
    member = candidates.select(source, key, ordinal, F.posexplode(named).alias("__g", "grp"))
    keep = 2 * limit
    if cursors is None:
        queue = top_per_group(member, [source, "grp"], [F.asc(ordinal)], keep, "rank").withColumn("offset", F.lit(0))
    else:
        span = F.floor(F.col(ordinal) / 100_000) if chunk is None else chunk
        ranked = chunked_row_number(member, [source, "grp"], [F.asc(ordinal)], span, "rank")
        offset = F.coalesce(F.col("next"), F.lit(0)) % F.col("rank_of")
        queue = (
            ranked.join(cursors.select(source, "grp", "next"), [source, "grp"], "left")
            .withColumn("offset", offset)
            .withColumn("rank", F.pmod(F.col("rank") - 1 - F.col("offset"), F.col("rank_of")) + 1)
            .filter(F.col("rank") <= keep)
            .drop("next", "rank_of")
        )
    first = member.groupBy(source, "grp").agg(F.min(F.struct(ordinal, "__g")).alias("__first"))
    rows = queue.drop("__g").join(first, [source, "grp"]).select(
        source,
        key,
        "grp",
        F.col("rank").cast("long"),
        F.col("offset").cast("long"),
        F.col(f"__first.{ordinal}").alias("g1"),
        F.col("__first.__g").alias("g2"),
    )

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        heads = pdf[["grp", "g1", "g2", "offset"]].drop_duplicates("grp").sort_values(["g1", "g2"])
        queues = {g: list(pdf[pdf.grp == g].sort_values("rank")[key]) for g in heads["grp"]}
        seen = dict.fromkeys(queues, 0)
        taken: dict = {}
        while len(taken) < limit:
            before = len(taken)
            for g, queue_keys in queues.items():
                while seen[g] < len(queue_keys) and queue_keys[seen[g]] in taken:
                    seen[g] += 1
                if seen[g] < len(queue_keys):
                    taken[queue_keys[seen[g]]] = g
                    seen[g] += 1
                if len(taken) == limit:
                    break
            if len(taken) == before:
                break
        n = len(queues)
        return pd.DataFrame(
            {
                source: [pdf[source].iloc[0]] * (len(taken) + n),
                key: pd.Series([*taken, *[None] * n], dtype=object),
                "position": [*range(1, len(taken) + 1), *[0] * n],
                "grp": [*taken.values(), *queues],
                "next": pd.Series([*[None] * len(taken), *(heads["offset"].to_numpy() + list(seen.values()))], dtype="Int64"),
            }
        )

    types = dict(candidates.dtypes)
    schema = f"{source} {types[source]}, {key} {types[key]}, position int, grp string, next long"
    return rows.groupBy(source).applyInPandas(take, schema)


def fair_selection_fast(
    member: DataFrame, limit: int, source: str = "source_id", key: str = "notice_key", ordinal: str = "ordinal"
) -> DataFrame:
    """Relational variant for rows with one group each: (rank in group, group) order, first ``limit``."""
    queue = top_per_group(member, [source, "grp"], [F.asc(ordinal)], limit, "rank")
    return top_per_group(queue, [source], [F.asc("rank"), F.asc("grp")], limit, "position")


def deferred(candidates: DataFrame, selected: DataFrame, key: str = "notice_key") -> DataFrame:
    """Candidates left for a later run."""
    return candidates.join(selected.select(key), key, "left_anti").withColumn(
        "extraction_status", F.lit("not-processed")
    )


def term_plan(terms: DataFrame, bucket: Column | int = 0) -> DataFrame:
    """Category-first search plan: every group's first term, then every second term, from a rotated group.

    ``terms`` has group_index, grp and terms (array).
    """
    start = F.lit(bucket) if isinstance(bucket, int) else bucket
    n = terms.agg(F.count(F.lit(1)).alias("__n"))
    rows = terms.select("group_index", "grp", F.posexplode("terms").alias("term_index", "term")).crossJoin(n)
    turn = F.pmod(F.col("group_index") - start, F.col("__n"))
    return rows.select("grp", "term", "term_index", turn.alias("turn")).orderBy("term_index", "turn")


def search_terms(spark) -> DataFrame:
    rows = [(i, g, t) for i, (g, t) in enumerate(rules.SEARCH_TERMS)]
    return spark.createDataFrame(rows, "group_index int, grp string, terms array<string>")


# Fixed value: documents read per run, which sets the rotation stride.
DOCUMENT_BUDGET = 280


def _stride(n: Column, groups: int) -> Column:
    """The smallest step from the budget's share on that is coprime to ``n``."""

    def divisor(a: Column, b: Column) -> Column:
        # Euclid: a long number needs fewer rounds than five for each of its decimal digits
        rounds = F.sequence(F.lit(1), F.lit(5) * F.length(b.cast("string")) + 1)
        start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
        step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b")))
        return F.aggregate(rounds, start, step, lambda s: s["a"])

    first = max(1, DOCUMENT_BUDGET // groups)
    # the next number that exceeds n by one is coprime to it, so the search is short
    steps = F.sequence(F.lit(first), F.lit(first) + F.least(n, F.lit(64)))
    near = F.get(F.filter(steps, lambda s: divisor(n, s) == 1), F.lit(0))
    every = F.sequence(F.lit(first), F.lit(first) + n)
    return F.coalesce(near, F.get(F.filter(every, lambda s: divisor(n, s) == 1), F.lit(0)))


def interleave(
    candidates: DataFrame,
    region_order: list[str],
    bucket: int = 0,
    region: str = "region_queue",
    group: str = "grp",
    ordinal: str = "ordinal",
    groups: int = len(rules.SEARCH_TERMS),
    chunk: Column | None = None,
) -> DataFrame:
    """Two-level interleave with a ``position``: categories inside a region, then regions.

    Each (region, category) list is rotated by a stride coprime to its length, so
    every row is reached in as many buckets as the list is long.  Positions are
    computed with distributed ranks; the result keeps every row.
    """
    span = F.floor(F.col(ordinal) / 100_000) if chunk is None else chunk
    ranked = chunked_row_number(candidates, [region, group], [F.asc(ordinal)], span, "r")
    sizes = ranked.groupBy(region, group).agg(F.max("r_of").alias("n"), F.min(ordinal).alias("first"))
    sizes = sizes.withColumn("shift", F.pmod(F.lit(bucket) * _stride(F.col("n"), groups), F.col("n")))
    order = F.array_position(F.array(*[F.lit(r) for r in region_order]), F.col(region))
    turned = (
        ranked.join(sizes, [region, group])
        .withColumn("turn", F.pmod(F.col("r") - 1 - F.col("shift"), F.col("n")))
        .withColumn("region_turn", order)
    )
    inner = chunked_row_number(
        turned, [region], [F.asc("turn"), F.asc("first")], F.floor(F.col("turn") / 1000), "in_region"
    )
    return (
        inner.withColumn("position", F.struct("in_region", "region_turn"))
        .drop("r", "r_of", "n", "first", "shift", "turn", "in_region_of")
    )


def region_queue(df: DataFrame) -> DataFrame:
    """Region named by a regional health department, else UNLOCATED."""
    found = F.coalesce(
        *[F.when(regional_health_department(F.col("department"), F.lit(r)), F.lit(r)) for r in REGIONS]
    )
    return df.withColumn("region_queue", F.coalesce(found, F.lit("UNLOCATED")))


def local_evidence_score(df: DataFrame) -> Column:
    """100 for a regional health department, 10 for a health-like department, else 0."""
    regional = F.lit(False)
    for r in REGIONS:
        regional = regional | regional_health_department(F.col("department"), F.lit(r))
    return F.when(regional, 100).when(F.col("department").rlike("(?i)health|medical|military|railway"), 10).otherwise(0)


def organisation_window(names: DataFrame, bucket: int, pinned: Column, limit: int = 6, pins: int = 2) -> DataFrame:
    """Up to two pinned names first, the rest rotated by the bucket, at most ``limit`` rows.

    ``names`` has name and ordinal; it is a short list of buyers of one region.
    """
    work = names.withColumn("__pin", pinned)
    pin_rank = F.row_number().over(Window.partitionBy("__pin").orderBy("ordinal"))
    work = work.withColumn("__pinned", F.col("__pin") & (pin_rank <= pins))
    rest = Window.partitionBy("__pinned").orderBy("ordinal")
    n = F.count(F.lit(1)).over(Window.partitionBy("__pinned"))
    turn = F.when(F.col("__pinned"), F.row_number().over(rest) - 1).otherwise(
        F.pmod(F.row_number().over(rest) - 1 - F.lit(bucket), n)
    )
    return (
        work.withColumn("turn", turn)
        .orderBy(F.desc("__pinned"), "turn")
        .limit(limit)
        .drop("__pin", "__pinned")
    )


def document_order(documents: DataFrame, limit: int = 8, key: str = "notice_key") -> DataFrame:
    """First documents of each notice: amendments, technical, price schedules, then the rest."""
    kind = (
        F.when(F.col("doc_type") == "corrigendum", 0)
        .when(F.col("doc_type") == "technical-specification", 1)
        .when(F.col("doc_type") == "boq", 2)
        .otherwise(3)
    )
    return top_per_group(
        documents.withColumn("__kind", kind), [key], [F.asc("__kind"), F.asc("ordinal")], limit, "position"
    ).drop("__kind")


def listing_candidates(df: DataFrame, assigned: Column, relevant: Column, generic: Column, regional: Column) -> DataFrame:
    """Candidate filter with flags kept for its rejection counts."""
    worded = F.col("title").rlike(r"(?i)\b(?:equipment|machineries|DIAMONDS)\b")
    wide = relevant | generic | worded
    return df.withColumns(
        {
            "is_assigned": assigned | regional,
            "is_wide_relevant": wide,
            "is_candidate": (assigned | regional) & (wide | regional),
        }
    )
