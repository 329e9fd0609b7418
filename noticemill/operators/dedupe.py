"""One survivor per notice out of many mirrors, with merged provenance.

The merge rule is ordered: each record meets the survivors so far and joins the
first one it matches; the better of the two gives the survivor its identity, and
documents of both stay.  That order only matters inside a set of records that can
match at all, so the job

1. writes what it needs of each record once, short, and names each record by its first key,
2. connects names over the other keys (a safe superset of the match rule; copies vanish here),
3. places the records of components of bounded size one by one, each component in
   one task; of the larger ones, 4 to 6,
4. takes components whose members all match each other as they are, by aggregates,
5. settles the other components in rounds: from a guess of who joins whom follows
   what each survivor looks like at any time, and from that each record's first
   match; a round in which no record changes its mind is the ordered result,
6. folds every group in order, in chunks of bounded size, to find its best record
   and the ones that were best for a while.

The match rule is written as equal keys, offered by a survivor and asked for by a
record, so all steps are joins and aggregates.  Provenance stays in child tables
(references, documents, amendments).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import instant, within
from ..functions.identifiers import (
    calendar_prefix,
    first_present,
    identity_key,
    item_reference,
    present,
    retender_signature,
)
from ..functions.patterns import matches
from ..functions.urls import specific_document
from ..plans.lineage import Scratch, cut
from .components import contracted_components
from .ordered_fold import (
    ANY,
    LEAF_ROWS,
    NONE,
    RECORD,
    document_set,
    first_matches,
    fold_members,
    item_column,
    item_parts,
    place_components,
    standing_column,
)
from .ranking import chunked_row_number, first_rows

# Which sources are live indexes, and the portal/mirror pair.
INDEX_SOURCE = r"^gem-direct(?:-|$)|^gem-priority-keywords$"
INDEX_ID = r"^GEM\/20\d{2}\/[BR]\/\d+$"
PORTAL_SOURCE, MIRROR_SOURCE, PAIR_ENTITY = "cppp-pgimer", "pgimer-notices", "pgimer"
PORTAL_ID = r"^20\d{2}_PGIME_\d+_\d+$"
FRESH_SECONDS, AHEAD_SECONDS = 86_400, 300

IDENTITY = ["id", "tkey", "authority", "day", "title", "url", "reference", "item", "role", "docs"]
FLAGS = ["terminal", "index", "stale", "fresh_index", "fresh_portal", "detail"]


def _col(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def index_source(source_id: Column) -> Column:
    return matches(source_id, INDEX_SOURCE, "")


def identity_columns(tenders: DataFrame, now: Column) -> DataFrame:
    """Narrow table: identity, decision class and order of each record."""
    return told_columns(narrow_columns(tenders, now))


def told_columns(narrow: DataFrame) -> DataFrame:
    """The identity table from what is written of it."""
    own = {"docs": document_set(F.col("items")), "own": F.size("items").cast("long"), "standing": _standing()}
    return narrow.withColumns(own).drop("flags")


def _standing() -> Column:
    flags = {name: F.col("flags").bitwiseAND(F.lit(1 << i)) != 0 for i, name in enumerate(FLAGS)}
    pair = F.when(F.col("role").isNotNull(), F.md5(F.concat_ws("\x01", F.col("item"), F.col("title"))))
    return standing_column(flags, F.col("role"), pair)


def narrow_columns(tenders: DataFrame, now: Column) -> DataFrame:
    """What the merge has to know of each record, without what follows from it."""
    # Read in several places and worked out once: Spark does not copy a costly column that is read twice.
    tenders = tenders.withColumns(
        {
            "__item": item_reference(_col(tenders, "reference_number")),
            "__tender_id": present(_col(tenders, "tender_id")),
            "__observed": instant(first_present(_col(tenders, "checked_at"), _col(tenders, "fetched_at"))),
        }
    )
    item, tender_id, observed = F.col("__item"), F.col("__tender_id"), F.col("__observed")
    docs = _col(tenders, "documents", "array<struct<label:string,url:string>>")
    portal = (
        (F.col("source_id") == PORTAL_SOURCE)
        & (_col(tenders, "institution_id") == PAIR_ENTITY)
        & matches(tender_id, PORTAL_ID)
        & item.isNotNull()
    )
    mirror = (
        (F.col("source_id") == MIRROR_SOURCE)
        & (_col(tenders, "institution_id") == PAIR_ENTITY)
        & tender_id.isNull()
        & item.isNotNull()
    )
    stale = _flag(_col(tenders, "stale", "boolean"))
    is_index = index_source(F.col("source_id")) & matches(tender_id, INDEX_ID)
    recent = within(observed, now, FRESH_SECONDS, AHEAD_SECONDS)
    detail = _flag(_col(tenders, "verification") == "detail")
    amendments = _col(tenders, "corrigenda", f"array<struct<{AMENDMENT}>>")
    described = present(_col(tenders, "description")).isNotNull()
    url = _col(tenders, "tender_url")
    reference = _col(tenders, "reference_number")
    role = F.when(portal, "portal").when(mirror, "mirror")
    flags = {
        "terminal": _flag(F.col("status").isin("CANCELLED", "WITHDRAWN")),
        "index": is_index,
        "stale": stale,
        "fresh_index": is_index & ~stale & recent & instant(_col(tenders, "extended_closing_date")).isNotNull(),
        "fresh_portal": _flag(F.col("source_id") == PORTAL_SOURCE)
        & detail
        & ~stale
        & recent
        & instant(_col(tenders, "effective_closing_date")).isNotNull(),
        "detail": detail,
    }
    items = F.concat(
        F.transform(F.coalesce(docs, F.array()), lambda d: item_column("doc", F.coalesce(d["url"], F.lit("")))),
        F.transform(F.coalesce(amendments, F.array()), lambda c: item_column("amendment", F.to_json(c))),
        F.when(described, F.array(item_column("described", F.lit("")))).otherwise(F.array()),
    )
    return tenders.select(
        "notice_key",
        F.col("ordinal").cast("long").alias("ordinal"),
        F.col("id").alias("id"),
        F.lower(F.trim(tender_id)).alias("tkey"),
        F.nullif(
            identity_key(
                first_present(_col(tenders, "institution_id"), _col(tenders, "organisation"), _col(tenders, "buyer"))
            ),
            F.lit(""),
        ).alias("authority"),
        present(calendar_prefix(_col(tenders, "publish_date"))).alias("day"),
        identity_key(F.col("title")).alias("title"),
        F.when(specific_document(url), url).alias("url"),
        # A reference of marks only is still a reference, with an empty key.
        F.when(present(reference).isNotNull(), identity_key(reference)).alias("reference"),
        item.alias("item"),
        role.alias("role"),
        _flag(F.size(docs) > F.size(F.array_distinct(F.transform(docs, lambda d: d["url"])))).alias("repeats"),
        sum((F.when(flags[name], 1 << i).otherwise(0) for i, name in enumerate(FLAGS)), F.lit(0)).alias("flags"),
        F.coalesce(F.unix_micros(observed), F.lit(-(2**62))).alias("observed"),
        items.alias("items"),
    )


AMENDMENT = "title:string,type:string,published_date:string,revised_closing_date:string,url:string"


def _with_documents(refs: Column, docs: Column) -> Column:
    return F.transform(refs, lambda r: F.md5(F.concat(r, docs)))


def _key_parts() -> dict[str, tuple[Column, list[str]]]:
    """By tag, where a record has the key of one of the positive match clauses, and what the key is made of."""
    c = F.col
    return {
        "i": (c("id").isNotNull(), ["id"]),
        "t": (c("tkey").isNotNull(), ["tkey"]),
        "u": (c("url").isNotNull(), ["title", "url"]),
        "r": (c("reference").isNotNull() & c("authority").isNotNull(), ["reference", "title", "authority"]),
        "p": (c("role").isNotNull(), ["item", "title"]),
    }


def names_and_links() -> dict[str, Column]:
    """``name``, a hash of a record's first key, and ``links``, hashes of the others.

    Records of one name are connected.  An id comes first and is a link of nobody; a record that is named by another
    key has it among its links as well, as others may.  Hashes that clash connect more than they must, which is safe.
    """
    hashed = {tag: F.when(ok, F.xxhash64(F.lit(tag), *parts)) for tag, (ok, parts) in _key_parts().items()}
    first, *others = hashed.values()
    lone = F.xxhash64(F.lit("-"), "notice_key", "ordinal")
    return {"name": F.coalesce(first, *others, lone), "links": F.array_compact(F.array(*others))}


def match_keys() -> Column:
    """Every key one of the positive match clauses needs; sharing none means no match."""

    made = [F.when(ok, F.concat_ws("|", F.lit(tag), *parts)) for tag, (ok, parts) in _key_parts().items()]
    return F.array_compact(F.array(*made))


def _keys(tag: str, ok: Column, fixed: list[Column], options: list[list[Column]]) -> Column:
    """An array with a hashed key for each choice of one option from each list."""
    choices: list[list[Column]] = [[]]
    for more in options:
        choices = [[*c, o] for c in choices for o in more]
    made = [F.md5(F.concat_ws("\x01", F.lit(tag), *fixed, *c)) for c in choices]
    # An option that is null, or a part that is missing, gives no key.
    valid = [F.when(ok & _all_present([*fixed, *c]), k) for c, k in zip(choices, made, strict=True)]
    return F.array_compact(F.array(*valid)) if valid else F.array().cast("array<string>")


def _all_present(parts: list[Column]) -> Column:
    ok = F.lit(True)
    for p in parts:
        ok = ok & p.isNotNull()
    return ok


def _named(value: Column) -> Column:
    return F.concat(F.lit("="), value)


def offered_keys() -> dict[str, Column]:
    """Keys under which a survivor can be found: ``fixed`` ones, and ``refs`` that its documents complete.

    Where the rule lets a missing value match anything, a survivor stands under its own value (or the mark of a missing
    one) and under a key for any; a record that has the value asks for it and for the missing one, a record without asks
    for any.  Two present tender ids decide alone, so every other clause is offered to records without one and, by
    survivors without one, to all.
    """
    c = F.col
    anything, nothing = F.lit(ANY), F.lit(NONE)
    other = [anything, F.when(c("tkey").isNull(), NONE)]
    authority = [anything, F.coalesce(_named(c("authority")), nothing)]
    day = [anything, F.coalesce(_named(c("day")), nothing)]
    yes = F.lit(True)
    return {
        "fixed": F.concat(
            _keys("t", yes, [c("tkey")], []),
            _keys("i", yes, [c("id")], [other]),
            _keys("p", yes, [c("role"), c("item"), c("title")], []),
            _keys("u", yes, [c("url"), c("title")], [other, authority, day]),
        ),
        "refs": _keys("r", yes, [c("reference"), c("title"), c("authority")], [other, day]),
    }


def completed(refs: Column, docs: Column) -> Column:
    """The keys by reference of a survivor with these documents: they veto a record that has others."""
    own = F.coalesce(_named(docs), F.lit(NONE))
    return F.concat(*[_with_documents(refs, d) for d in (F.lit(ANY), own)])


def asked_keys() -> Column:
    """Keys that a record looks its survivor up by."""
    c = F.col
    other = [F.when(c("tkey").isNull(), ANY).otherwise(NONE)]

    def wanted(value: Column) -> list[Column]:
        return [F.when(value.isNull(), ANY).otherwise(_named(value)), F.when(value.isNotNull(), NONE)]

    yes = F.lit(True)
    opposite = F.when(c("role") == "portal", "mirror").when(c("role") == "mirror", "portal")
    refs = _keys("r", yes, [c("reference"), c("title"), c("authority")], [other, wanted(c("day"))])
    by_reference = [_with_documents(refs, d) for d in wanted(c("docs"))]  # null where the option is
    return F.concat(
        _keys("t", yes, [c("tkey")], []),
        _keys("i", yes, [c("id")], [other]),
        _keys("p", yes, [opposite, c("item"), c("title")], []),
        _keys("u", yes, [c("url"), c("title")], [other, wanted(c("authority")), wanted(c("day"))]),
        F.array_compact(F.concat(*by_reference)),
    )


def _single(value: str) -> Column:
    """Whether at most one distinct value is present in the group."""
    return F.coalesce(F.min(value) == F.max(value), F.lit(True))


def uniform_components(placed: DataFrame) -> DataFrame:
    """(component, by_id) of the components that need no order.

    ``by_id``: all records carry tender ids, which then decide alone.  Otherwise one key is shared by all signatures and
    nothing that its clause looks at differs, so every record matches every other, whichever of them is the best.
    """
    facts = placed.groupBy("component").agg(
        F.count(F.lit(1)).alias("n"),
        (~F.max(F.col("tkey").isNull())).alias("by_id"),
        _single("tkey").alias("one_id"),
        _single("authority").alias("one_authority"),
        _single("day").alias("one_day"),
        _single("docs").alias("one_set"),
        F.max(F.col("repeats")).alias("repeats"),
    )
    keys = placed.select("component", F.explode(match_keys()).alias("key")).groupBy("component", "key").agg(F.count(F.lit(1)).alias("held"))
    tag = F.substring("key", 1, 2)
    holds = (
        (tag == "t|")
        | ((tag == "i|") & F.col("one_id"))
        | ((tag == "u|") & F.col("one_id") & F.col("one_authority") & F.col("one_day"))
        | ((tag == "r|") & F.col("one_id") & F.col("one_day") & F.col("one_set") & ~F.col("repeats"))
    )
    shared = keys.join(facts, "component").filter((F.col("held") == F.col("n")) & holds)
    settled = shared.select("component", F.lit(False).alias("by_id")).distinct()
    return settled.union(facts.filter("by_id").select("component", "by_id")).groupBy("component").agg(F.min("by_id").alias("by_id"))


def settle_in_rounds(records: DataFrame, last_rank: int, leaf_rows: int) -> DataFrame:
    """(notice_key, grp) of records in mixed components, exactly as the ordered rule places them.

    A guess says which record opened the survivor that each record joined.  Folding the guessed groups in order tells
    what every survivor looked like at any time, and looking each record up among the survivors of its time gives the
    next guess.  What a record finds depends on earlier records only, so the first record is right after one round and
    each round settles at least the next one of a component; a guess that does not change is the ordered result.
    Components leave as soon as they are settled.  Few rounds are the rule; a chain in which each record's place
    hangs on the one before it needs as many as it has links, as an ordered rule must.
    """
    leaf = F.floor(F.col("rank") / F.lit(leaf_rows))
    done: DataFrame | None = None
    open_ = records
    rank = F.col("rank")
    states = records.select(
        "component", rank.alias("s"), rank.alias("since"), rank.alias("best"), "last", "docs", F.lit(2**62).alias("until")
    )
    guess = records.select("component", "rank", "notice_key", F.col("rank").alias("s"))
    while True:
        identity = open_.select("component", F.col("rank").alias("best"), "fixed", "refs")
        shown = states.join(identity, ["component", "best"]).withColumn("keys", F.concat("fixed", completed(F.col("refs"), F.col("docs"))))
        found = first_matches(shown, open_.select("component", "rank", F.col("asked").alias("keys")), last_rank, leaf_rows)
        told = cut(
            guess.select("component", "rank", "notice_key", F.col("s").alias("before"))
            .join(found, ["component", "rank"], "left")
            .withColumn("s", F.coalesce("s", "rank"))
        )
        moving = told.filter("s <> before").select("component").distinct()
        still = told.join(moving, "component", "left_anti").select("notice_key", F.concat_ws("/", "component", "s").alias("grp"))
        done = still if done is None else done.union(still)
        if moving.isEmpty():
            return done
        open_ = records.join(moving, "component", "left_semi")
        guess = told.join(moving, "component", "left_semi").select("component", "rank", "notice_key", "s")
        members = open_.join(guess.select("notice_key", "s"), "notice_key").withColumns(
            {"grp": F.concat_ws("/", "component", "s"), "at": F.col("rank"), "leaf": leaf, "raw_docs": F.coalesce("docs", F.lit(""))}
        )
        folded = fold_members(
            members.select("grp", "leaf", "at", "sig", "standing", "observed", "own", "raw_docs"),
            _evidence(members),
            last_rank >= leaf_rows,
        )
        lasts = open_.filter("rank = 0").select("component", "last")
        states = (
            folded.filter("until is not null")
            .select("grp", F.col("at").alias("since"), "until", "best", present(F.col("docs")).alias("docs"))
            .join(guess.select(F.concat_ws("/", "component", "s").alias("grp"), "component", "s").distinct(), "grp")
            .join(lasts, "component")
        )


def _evidence(members: DataFrame) -> DataFrame:
    items = members.select("grp", "at", F.explode("items").alias("i"))
    return items.select("grp", "at", *[c.alias(name) for name, c in item_parts(F.col("i")).items()])


@dataclass
class Deduplicated:
    """``members`` maps every record to its survivor; the rest is keyed by survivor."""

    survivors: DataFrame
    members: DataFrame
    references: DataFrame
    documents: DataFrame
    amendments: DataFrame

    def with_provenance(self) -> DataFrame:
        """Survivors with their provenance as ordered arrays."""

        def gathered(child: DataFrame, fields: list[str], out: str) -> DataFrame:
            item = F.struct("position", F.struct(*fields).alias("v"))
            return child.groupBy("notice_key").agg(
                F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]).alias(out)
            )

        drop = [c for c in ("source_references", "documents", "corrigenda") if c in self.survivors.columns]
        out = self.survivors.drop(*drop)
        out = out.join(gathered(self.references, ["source_id", "source_name", "url"], "source_references"), "notice_key", "left")
        out = out.join(gathered(self.documents, ["label", "url"], "documents"), "notice_key", "left")
        fields = ["title", "type", "published_date", "revised_closing_date", "url"]
        return out.join(gathered(self.amendments, fields, "corrigenda"), "notice_key", "left")


def assign_groups(narrow: DataFrame, scratch: Scratch, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(notice_key, ordinal, grp, survivor_key, won) for every record; ``won`` marks those that were the best when they came.

    ``narrow`` (``narrow_columns``) is a table of ``scratch`` and is dropped.  Components of up to ``leaf_rows`` records
    are placed one by one in a task; larger ones in rounds.
    """
    named = narrow.withColumns(names_and_links())
    roots = contracted_components(named.select(F.col("name").alias("node"), F.explode("links").alias("key")), scratch)
    sizes = named.groupBy("name").agg(F.count(F.lit(1)).alias("size")).join(roots.withColumnRenamed("node", "name"), "name", "left")
    # names of one record that share no key have no component
    met = sizes.filter("size > 1 OR root IS NOT NULL").select("name", F.coalesce("root", "name").alias("component"), "size")
    met = scratch.keep(met)
    scratch.drop(roots)
    large = met.groupBy("component").agg(F.sum("size").alias("size")).filter(F.col("size") > leaf_rows).select("component")
    unclear = narrow.groupBy("notice_key").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("ordinal").isNull()).alias("unplaced"))
    unclear = scratch.keep(unclear.filter("n > 1 OR unplaced OR notice_key IS NULL").select("notice_key"))
    clear = unclear.isEmpty()
    if not clear:  # records that no key tells apart, or without a place
        same = F.col("notice_key").eqNullSafe(F.col("__key"))
        held = named.join(unclear.withColumnRenamed("notice_key", "__key"), same, "left_semi").select("name")
        large = large.union(met.join(held, "name", "left_semi").select("component")).distinct()
    large = scratch.keep(large)
    rows = scratch.keep(named.drop("links").join(met.select("name", "component"), "name", "left").drop("name"))
    scratch.drop(met, *[narrow] if clear else [])
    alone = rows.filter("component IS NULL").select(
        "notice_key", "ordinal", F.hex(names_and_links()["name"]).alias("grp"), F.col("notice_key").alias("survivor_key"), F.lit(True).alias("won")
    )
    rows = rows.filter("component IS NOT NULL")
    in_rounds = not large.isEmpty()
    small = rows.join(large, "component", "left_anti") if in_rounds else rows
    # what follows from a record is made where it is placed: it is many times as long
    ordered = small.drop("repeats").repartition("component").sortWithinPartitions("component", "ordinal", "notice_key")
    found = alone.unionByName(place_components(ordered.withColumn("standing", _standing())))
    if in_rounds:
        found = found.unionByName(assign_in_rounds(rows.join(large, "component", "left_semi"), leaf_rows))
    if clear:
        return found
    # a key that several records have stands for each of their places
    known = found.filter("notice_key IS NOT NULL")
    several = known.join(unclear, "notice_key", "left_semi").drop("ordinal").join(narrow.select("notice_key", "ordinal"), "notice_key")
    return known.join(unclear, "notice_key", "left_anti").unionByName(several)


def _short(value: Column) -> Column:
    return F.unhex(F.md5(value))


def assign_in_rounds(rows: DataFrame, leaf_rows: int) -> DataFrame:
    """(notice_key, ordinal, grp, survivor_key, won) for records of components of any size."""
    sig_cols = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in IDENTITY]
    rows = told_columns(rows).withColumns({"component": F.hex("component"), "signature": _short(F.concat_ws("\x01", *sig_cols))})
    placed = cut(rows.groupBy("component", "signature").agg(*[F.first(c).alias(c) for c in [*IDENTITY, "repeats"]]))
    grp = F.when(F.col("by_id"), F.concat(F.lit("t|"), "tkey")).when(~F.col("by_id"), F.col("component"))
    order = [F.col("ordinal"), F.col("notice_key")]
    chunk = F.floor(F.col("ordinal") / F.lit(65_536))
    rows = rows.join(uniform_components(placed), "component", "left").withColumn("grp", grp).drop("by_id")
    ranked = cut(
        chunked_row_number(rows, ["component"], order, chunk)
        .withColumns({"rank": F.col("rank") - 1, "last": F.col("rank_of") - 1})
        .drop("rank_of")
    )
    mixed = ranked.filter("grp is null")
    last_rank, last_mixed = ranked.agg(F.max("last"), F.max(F.when(F.col("grp").isNull(), F.col("last")))).first()
    if last_mixed is not None:
        offers = {**offered_keys(), "asked": asked_keys()}
        records = mixed.withColumns(offers).withColumn("sig", F.md5(F.concat_ws("|", "fixed", "refs")))
        kept = ["component", "rank", "last", "notice_key", "standing", "observed", "own", "docs", "items", "fixed", "refs", "sig", "asked"]
        settled = settle_in_rounds(cut(records.select(*kept)), last_mixed, leaf_rows)
        told = settled.select("notice_key", F.col("grp").alias("settled"))
        ranked = ranked.join(told, "notice_key", "left").withColumn("grp", F.coalesce("grp", "settled")).drop("settled")
    members = cut(
        ranked.select(
            "notice_key", "ordinal", "grp", F.col("rank").alias("at"), F.floor(F.col("rank") / F.lit(leaf_rows)).alias("leaf"),
            "standing", "observed", "own", "items",
        )
    )
    folded = fold_members(
        members.select("grp", "leaf", "at", F.lit("").alias("sig"), "standing", "observed", "own", F.lit("").alias("raw_docs")),
        _evidence(members),
        (last_rank or 0) >= leaf_rows,
    )
    folded = cut(folded.select("grp", "at", "won", "best"))
    final = folded.groupBy("grp").agg(F.max_by("best", "at").alias("at"))
    survivor = final.join(members, ["grp", "at"]).select("grp", F.col("notice_key").alias("survivor_key"))
    return members.join(folded, ["grp", "at"]).join(survivor, "grp").select("notice_key", "ordinal", "grp", "survivor_key", "won")


# Values a survivor takes from another member when its own is missing.
FILLED = ["description", "tender_category", "product_category", "procurement_category", "work_category"]


def _kept_specification() -> Column:
    """Of a group's specifications the one that the ordered merge keeps.

    A parsed one gives way only to a better record's parsed one.  An unparsed one gives way to any that a record brings
    that does not become the best, and to a parsed one.
    """
    parsed = F.exists(F.col("specification.document_sources"), lambda d: d["status"] == "parsed")
    parsed = F.col("specification").isNotNull() & _flag(parsed)
    plain = F.col("specification").isNotNull() & ~parsed

    def last(ok: Column) -> Column:
        return F.max_by("specification", F.when(ok, F.col("ordinal")))

    def first(ok: Column) -> Column:
        return F.min_by("specification", F.when(ok, F.col("ordinal")))

    won = F.col("__won")
    return F.coalesce(last(won & parsed), first(parsed), last(~won & plain), first(won & plain))


def deduplicate(tenders: DataFrame, now: Column, leaf_rows: int = LEAF_ROWS) -> Deduplicated:
    """Merge mirrors. ``tenders`` needs ``notice_key`` (unique), ``ordinal``, ``id``,
    ``title``, ``source_id`` and ``status``; other notice columns are used when present.

    A value that a survivor fills comes from the last record that was the best and has it, else from the first member
    that has it.  Groups are folded in chunks of ``leaf_rows`` places.
    """
    with Scratch(tenders.sparkSession) as scratch:
        # The narrow table is read several times; write it once.
        narrow = scratch.keep(narrow_columns(tenders, now))
        members = cut(scratch.keep(assign_groups(narrow, scratch, leaf_rows)))
    members = members.withColumn("is_survivor", F.col("notice_key") == F.col("survivor_key"))
    # Survivor first, then the other members in input order.
    place = F.struct((~F.col("is_survivor")).alias("other"), F.col("ordinal").alias("ordinal"))
    linked = tenders.drop("ordinal").join(
        members.select("notice_key", "survivor_key", "is_survivor", "ordinal", F.col("won").alias("__won"), place.alias("__place")), "notice_key"
    )
    fill = [c for c in FILLED if c in tenders.columns]
    lists = {
        "priority_categories": "array<string>",
        "equipment_items": None,
    }
    aggs = [F.count(F.lit(1)).alias("member_count")]

    def filled(name: str, has: Column) -> Column:
        best = F.max_by(name, F.when(has & F.col("__won"), F.col("ordinal")))
        return F.coalesce(best, F.min_by(name, F.when(has, F.col("ordinal")))).alias(f"__{name}")

    aggs += [filled(c, present(F.col(c)).isNotNull()) for c in fill]
    if "equipment_items" in tenders.columns:
        aggs.append(filled("equipment_items", F.size("equipment_items") > 0))
    if "specification" in tenders.columns:
        aggs.append(_kept_specification().alias("__specification"))
    if "priority_categories" in tenders.columns:
        # At most the fixed number of priority groups, so the set stays small.
        flat = F.flatten(F.collect_set("priority_categories"))
        aggs.append(F.sort_array(F.array_distinct(flat)).alias("__priority_categories"))
    merged = linked.groupBy("survivor_key").agg(*aggs)
    kept = linked.filter("is_survivor").drop("survivor_key", "is_survivor", "__won", "__place")
    survivors = kept.join(merged, kept["notice_key"] == merged["survivor_key"]).drop("survivor_key")
    for c in fill:
        survivors = survivors.withColumn(c, F.coalesce(present(F.col(c)), F.col(f"__{c}"))).drop(f"__{c}")
    if "equipment_items" in tenders.columns:
        own = F.when(F.size("equipment_items") > 0, F.col("equipment_items"))
        survivors = survivors.withColumn("equipment_items", F.coalesce(own, "__equipment_items")).drop("__equipment_items")
    if "specification" in tenders.columns:
        survivors = survivors.withColumn("specification", F.col("__specification")).drop("__specification")
    if "priority_categories" in tenders.columns:
        own = F.coalesce(F.col("priority_categories"), F.array().cast(lists["priority_categories"]))
        survivors = survivors.withColumn(
            "priority_categories", F.array_union(own, F.col("__priority_categories"))
        ).drop("__priority_categories")

    def child(items: Column, fields: list[str], by: list[str]) -> DataFrame:
        rows = linked.select(F.col("survivor_key").alias("notice_key"), "__place", F.posexplode(items).alias("i", "v"))
        flat = rows.select(
            "notice_key",
            *[F.col(f"v.{f}").alias(f) for f in fields],
            F.struct(F.col("__place.other").alias("other"), F.col("__place.ordinal").alias("ordinal"), "i").alias("position"),
        )
        return first_rows(flat, ["notice_key", *by], ["position"])

    own_reference = F.array(
        F.struct(
            F.col("source_id").alias("source_id"),
            _col(tenders, "source_name").alias("source_name"),
            first_present(_col(tenders, "tender_url"), _col(tenders, "source_url")).alias("url"),
        )
    )
    reference_type = "array<struct<source_id:string,source_name:string,url:string>>"
    listed = _col(tenders, "source_references", reference_type)
    references = child(
        F.concat(F.coalesce(listed, F.array().cast(reference_type)), own_reference),
        ["source_id", "source_name", "url"],
        ["source_id", "source_name", "url"],
    )
    documents = child(_col(tenders, "documents", "array<struct<label:string,url:string>>"), ["label", "url"], ["url"])
    amendment_fields = ["title", "type", "published_date", "revised_closing_date", "url"]
    amendments = child(
        _col(
            tenders,
            "corrigenda",
            "array<struct<title:string,type:string,published_date:string,revised_closing_date:string,url:string>>",
        ),
        amendment_fields,
        amendment_fields,
    )
    return Deduplicated(
        survivors, members.select("notice_key", "survivor_key", "grp"), references, documents, amendments
    )


# Wording of a repeated notice.
RETENDER_WORDS = r"re[ -]?tender|fresh tender|re.invited|recalled|reissued"


def link_retenders(records: DataFrame, eligible: Column) -> DataFrame:
    """Add ``replaces``: the first ended record with the same scope and title signature.

    ``eligible`` marks current priority rows.  A missing scope equals a missing scope.
    Ended rows are reduced to the first per (scope, signature) before the join.
    """
    work = records.withColumns(
        {
            "__scope": first_present(_col(records, "institution_id"), _col(records, "organisation")),
            "__sig": retender_signature(F.col("title")),
        }
    )
    ended = work.filter(_flag(_col(records, "cancelled", "boolean")) | _flag(_col(records, "withdrawn", "boolean")))
    label = first_present(_col(records, "tender_id"), _col(records, "reference_number"), F.col("title"))
    entry = F.struct("ordinal", "notice_key", label.alias("label"))
    # Two candidates suffice: a row never replaces itself.
    first = ended.groupBy(F.col("__scope").alias("__s"), F.col("__sig").alias("__g")).agg(F.min(entry).alias("__a"))
    same = F.col("__scope").eqNullSafe(F.col("__s")) & (F.col("__sig") == F.col("__g"))
    second = (
        ended.join(first, same)
        .groupBy("__s", "__g")
        .agg(F.first("__a").alias("__a"), F.min(F.when(F.col("ordinal") > F.col("__a.ordinal"), entry)).alias("__b"))
    )
    wording = F.concat_ws(" ", F.col("title"), F.coalesce(_col(records, "reference_number"), F.lit("undefined")))
    retender = eligible & matches(wording, RETENDER_WORDS)
    joined = work.join(second, same, "left")
    pick = F.when(F.col("__a.notice_key") != F.col("notice_key"), F.col("__a.label")).otherwise(F.col("__b.label"))
    return joined.withColumn("replaces", F.when(retender, pick)).drop("__scope", "__sig", "__s", "__g", "__a", "__b")
