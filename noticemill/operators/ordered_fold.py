"""Ordered folds of long groups in bounded chunks, and first matches as of a place in the order.

A group's members meet its current best one by one, and the outcome depends on their order.  Members stand in chunks
of a bounded number of ranks.  Each chunk is first described as a function of whoever enters it, one pass over the
chunks' descriptions gives everyone who enters, and a second pass over the members replays each chunk on its own.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

LEAF_ROWS = 10_000  # ranks in a chunk
SEPARATOR = "\x1f"
ALWAYS = 2**63 - 1  # above every doubled time


class Standing(NamedTuple):
    """What decides between two records before their times are compared."""

    terminal: bool
    index: bool
    stale: bool
    fresh_index: bool
    fresh_portal: bool
    detail: bool
    role: str
    pair: str


def standing_column(flags: dict[str, Column], role: Column, pair: Column) -> Column:
    bits = [F.when(flags[name], "1").otherwise("0") for name in Standing._fields[:6]]
    return F.concat_ws(SEPARATOR, *bits, F.coalesce(role, F.lit("")), F.coalesce(pair, F.lit("")))


@lru_cache(100_000)
def standing(text: str) -> Standing:
    *bits, role, pair = text.split(SEPARATOR)
    return Standing(*(b == "1" for b in bits), role, pair)


@lru_cache(100_000)
def outranks(new: str, old: str) -> bool | None:
    """Whether a newcomer's standing alone beats the one it meets; None: their times decide."""
    if not old:
        return True
    n, o = standing(new), standing(old)
    if n.terminal != o.terminal:
        return n.terminal
    if (n.index or o.index) and n.stale != o.stale:
        return not n.stale
    paired = {n.role, o.role} == {"portal", "mirror"} and n.pair == o.pair
    if paired and n.fresh_portal != o.fresh_portal:
        return n.fresh_portal
    if n.fresh_index != o.fresh_index:
        return n.fresh_index
    return None


def wins_tie(new: str, own: int, old: str, gathered: int) -> bool:
    """Whether a newcomer with ``own`` evidence is better than a record that has ``gathered`` so much."""
    return 10 * standing(new).detail + own > 10 * standing(old).detail + gathered


def runs_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of a sorted partition in runs whose first ``keys`` values are equal."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[:keys] != rows[0][:keys]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


# Members as rows: who they are, what they bring, and what the group had gathered before their chunk.
MEMBER = {
    "grp": "string", "leaf": "long", "at": "long", "sig": "string", "standing": "string", "observed": "long",
    "own": "long", "raw_docs": "string", "new_q": "long", "new_n": "long", "new_a": "long", "new_b": "long",
    "prior_q": "long", "prior_n": "long", "prior_a": "long", "prior_b": "long", "prior_rows": "long",
    "first_own": "long", "next_at": "long",
}
Member = NamedTuple("Member", [(name, object) for name in MEMBER])
ENTERING = {"in_at": "long", "in_standing": "string", "in_observed": "long", "in_sig": "string"}


def _gathered(members: list[Member]) -> list[int]:
    """Evidence that the group holds before each member; the second member meets the first as it came."""
    out, total = [], members[0].prior_q
    for i, m in enumerate(members):
        out.append((m.first_own if m.prior_rows else members[0].own) if m.prior_rows + i == 1 else total)
        total += m.new_q
    return out


class Outcomes:
    """Who leaves a chunk, by the time of whoever enters it with one standing: steps of rising bounds."""

    def __init__(self):
        self.bounds: list[int] = []  # falling, so that the lowest bound is last
        self.last: list[int] = []

    def of(self, observed: int) -> int | None:
        above = bisect_left(self.bounds, -2 * observed, key=lambda b: -b)  # bounds above twice the time
        return self.last[above - 1] if above else None

    def override(self, bound: int, last: int) -> None:
        while self.bounds and self.bounds[-1] <= bound:
            self.bounds.pop()
            self.last.pop()
        self.bounds.append(bound)
        self.last.append(last)


def describe(members: list[Member], entering: list[str]) -> list[tuple]:
    """(standing, bounds, places): for each standing that may enter, which member leaves below which doubled time."""
    kinds = sorted({*entering, *(m.standing for m in members)})
    steps = {k: Outcomes() for k in kinds}
    gathered = _gathered(members)
    for i in range(len(members) - 1, -1, -1):
        m = members[i]
        further = steps[m.standing].of(m.observed)
        last = i if further is None else further
        for k in kinds:
            rule = outranks(m.standing, k)
            if rule is None:
                tie = wins_tie(m.standing, m.own, k, gathered[i])
                steps[k].override(2 * m.observed + tie, last)
            elif rule:
                steps[k].override(ALWAYS, last)
    return [(k, steps[k].bounds, steps[k].last) for k in entering]


def replay(members: list[Member], entering: tuple) -> list[tuple]:
    """(grp, at, won, best, docs, until) of a chunk's members; ``until`` is null where identity and documents stay."""
    best, kind, time, sig = entering
    n, a, b = members[0].prior_n, members[0].prior_a, members[0].prior_b
    out, shown = [], None
    for i, (m, gathered) in enumerate(zip(members, _gathered(members), strict=True)):
        won = outranks(m.standing, kind or "")
        if won is None:
            won = m.observed > time or (m.observed == time and wins_tie(m.standing, m.own, kind, gathered))
        if won:
            best, kind, time, sig = m.at, m.standing, m.observed, m.sig
        n, a, b = n + m.new_n, a + m.new_a, b + m.new_b
        docs = m.raw_docs if m.prior_rows + i == 0 else f"{n}:{a}:{b}" if n else ""
        out.append([m.grp, m.at, won, best, docs, None])
        if (sig, docs) != shown:
            shown = sig, docs
            out[-1][5] = -1
    until = members[-1].next_at if members[-1].next_at is not None else 2**62
    for row in reversed(out):
        if row[5] is not None:
            row[5], until = until, row[1]
    return [tuple(r) for r in out]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


DESCRIBED = pa.schema([
    ("grp", pa.string()), ("leaf", pa.int64()), ("kind", pa.string()), ("bounds", pa.list_(pa.int64())),
    ("ats", pa.list_(pa.int64())), ("kinds", pa.list_(pa.string())), ("times", pa.list_(pa.int64())),
    ("sigs", pa.list_(pa.string())),
])
ENTERED = pa.schema([("grp", pa.string()), ("leaf", pa.int64()), ("in_at", pa.int64()), ("in_standing", pa.string()),
                     ("in_observed", pa.int64()), ("in_sig", pa.string())])
REPLAYED = pa.schema([("grp", pa.string()), ("at", pa.int64()), ("won", pa.bool_()), ("best", pa.int64()),
                      ("docs", pa.string()), ("until", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {"int64": "long", "bool": "boolean", "list<item: int64>": "array<long>", "list<item: string>": "array<string>"}
    return ", ".join(f"{f.name} {kinds.get(str(f.type), str(f.type))}" for f in schema)


def _entering(members: DataFrame) -> DataFrame:
    """(grp, leaf, in_...): who enters each chunk of the groups that have more than one."""
    kinds = members.groupBy("grp").agg(F.collect_set("standing").alias("all_kinds"))  # a few standings a group

    def describe_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs_of(batches, 2):
            rows = [Member(*r[: len(MEMBER)]) for r in run]
            out = []
            for kind, bounds, places in describe(rows, ["", *run[0][len(MEMBER)]]):
                last = [rows[p] for p in places]
                out.append((rows[0].grp, rows[0].leaf, kind, bounds, [m.at for m in last], [m.standing for m in last],
                            [m.observed for m in last], [m.sig for m in last]))
            yield _batch(out, DESCRIBED)

    described = (
        members.join(kinds, "grp")
        .select(*MEMBER, "all_kinds")
        .repartition("grp", "leaf")
        .sortWithinPartitions("grp", "leaf", "at")
        .mapInArrow(describe_chunks, _ddl(DESCRIBED))
    )

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, state = None, None
        for run in runs_of(batches, 2):
            if run[0][0] != grp:
                grp, state = run[0][0], (None, "", 0, None)
            yield _batch([(grp, run[0][1], *state)], ENTERED)
            _, _, _, bounds, *last = next(r for r in run if r[2] == state[1])
            steps = Outcomes()
            steps.bounds, steps.last = bounds, list(zip(*last, strict=True))
            state = steps.of(state[2]) or state

    return described.repartition("grp").sortWithinPartitions("grp", "leaf").mapInArrow(carry, _ddl(ENTERED))


def fold_members(members: DataFrame, items: DataFrame, several: bool = True) -> DataFrame:
    """(grp, at, won, best, docs, until), one row per member: whether it became the best, and the best after it.

    ``members`` has grp, leaf, at (its place, unique in the group, growing with leaf), sig, standing, observed, own and
    raw_docs; ``items`` has grp, at, kind, item, a, b: evidence that counts once in a group, from its first member on.
    ``docs`` describes the documents gathered so far; ``until`` is set where identity or documents change, to the place
    of the next change.  Without ``several`` no group has more than one leaf.
    """
    first = items.groupBy("grp", "kind", "item").agg(F.min("at").alias("at"), F.first("a").alias("a"), F.first("b").alias("b"))
    doc = F.col("kind") == "doc"
    fresh = first.groupBy("grp", "at").agg(
        F.count(F.lit(1)).alias("new_q"),
        F.count(F.when(doc, 1)).alias("new_n"),
        F.sum(F.when(doc, F.col("a")).otherwise(0)).alias("new_a"),
        F.sum(F.when(doc, F.col("b")).otherwise(0)).alias("new_b"),
    )
    rows = members.join(fresh, ["grp", "at"], "left").na.fill(0, ["new_q", "new_n", "new_a", "new_b"])
    nobody = {name: F.lit(None).cast(kind) for name, kind in ENTERING.items()}
    if several:
        entered = _after_earlier_chunks(rows)
    else:
        alone = {name: F.lit(0 if name.startswith("prior") else None).cast("long") for name in list(MEMBER)[12:]}
        entered = rows.withColumns({**alone, **nobody})

    def replay_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for run in runs_of(batches, 2):
            out += replay([Member(*r[: len(MEMBER)]) for r in run], run[0][len(MEMBER) :])
            if len(out) >= LEAF_ROWS:
                yield _batch(out, REPLAYED)
                out = []
        yield _batch(out, REPLAYED)

    return (
        entered.select(*MEMBER, *ENTERING)
        .repartition("grp", "leaf")
        .sortWithinPartitions("grp", "leaf", "at")
        .mapInArrow(replay_chunks, _ddl(REPLAYED))
    )


def _after_earlier_chunks(rows: DataFrame) -> DataFrame:
    """Members with what the chunks before their own have gathered and who enters their chunk."""
    # A row for a chunk: what the chunks before it have gathered.
    sums = ["new_q", "new_n", "new_a", "new_b"]
    chunks = rows.groupBy("grp", "leaf").agg(
        *[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("rows"), F.min("at").alias("starts"),
        F.min_by("own", "at").alias("starts_own"),
    )
    order = Window.partitionBy("grp").orderBy("leaf")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = chunks.select(
        "grp",
        "leaf",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"prior_{c[-1]}") for c in sums],
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("prior_rows"),
        F.first("starts_own").over(order).alias("first_own"),
        F.lead("starts").over(order).alias("next_at"),
    )
    rows = cut(rows.join(placed, ["grp", "leaf"]).select(*MEMBER))
    several = rows.filter("prior_rows > 0").select("grp").distinct()
    return rows.join(_entering(rows.join(several, "grp", "left_semi")), ["grp", "leaf"], "left")


FOUND = pa.schema([("component", pa.string()), ("rank", pa.int64()), ("s", pa.int64())])


def first_matches(states: DataFrame, asked: DataFrame, last_rank: int, leaf_rows: int) -> DataFrame:
    """(component, rank, s): the smallest s among the states that share a key with a record and hold at its rank.

    ``states`` has component, s, since, until, last and keys: a state holds for ranks above ``since`` up to ``until``
    (and ``last``, its component's last rank).  ``asked`` has component, rank and keys.  A state is laid into the chunks
    of ranks where it begins and ends, and a sweep over each (key, chunk) answers what is asked there.  Chunks that it
    spans from end to end are covered by few blocks of 1, 2, 4... chunks, of which only the smallest s counts.
    """
    width = F.lit(leaf_rows)
    spread = (
        states.withColumn("until", F.least("until", "last"))
        .withColumn("since", F.col("since") + 1)
        .filter("since <= until")
        .withColumns({"leaf": F.floor(F.col("since") / width), "end": F.floor(F.col("until") / width)})
        .withColumn("key", F.explode("keys"))
    )
    begin = spread.select("key", "leaf", F.col("since").alias("at"), "s", "until", F.lit(None).cast("string").alias("component"))
    end = spread.filter("end > leaf").select(
        "key", F.col("end").alias("leaf"), (F.col("end") * width).alias("at"), "s", "until", F.lit(None).cast("string").alias("component")
    )
    questions = asked.select("component", "rank", F.floor(F.col("rank") / width).alias("leaf"), F.explode("keys").alias("key"))
    asks = questions.select(
        "key", "leaf", F.col("rank").alias("at"), F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("until"), "component"
    )

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, alive, out = None, [], []
        for batch in batches:
            for key, leaf, at, s, until, component in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, leaf) != where:
                    where, alive = (key, leaf), []
                if s is not None:
                    heapq.heappush(alive, (s, until))
                    continue
                while alive and alive[0][1] < at:
                    heapq.heappop(alive)
                if alive:
                    out.append((component, at, alive[0][0]))
            yield _batch(out, FOUND)
            out = []

    events = begin.union(end).union(asks).repartition("key", "leaf")
    # States come before questions of the same place.
    found = events.sortWithinPartitions("key", "leaf", "at", F.col("s").isNull()).mapInArrow(sweep, _ddl(FOUND))
    if last_rank >= 2 * leaf_rows:
        level = F.explode(F.sequence(F.lit(0), F.lit(max(1, last_rank // leaf_rows).bit_length())))
        inner = spread.filter("end - leaf > 1").select("key", "s", (F.col("leaf") + 1).alias("a"), (F.col("end") - 1).alias("b"), level.alias("level"))
        size = F.expr("shiftleft(1L, level)")
        ends = inner.withColumns({"a": F.ceil(F.col("a") / size), "b": F.floor((F.col("b") + 1) / size) - 1}).filter("a <= b")
        nodes = F.array_compact(F.array(F.when(F.col("a") % 2 == 1, F.col("a")), F.when(F.col("b") % 2 == 0, F.col("b"))))
        blocks = ends.select("key", "level", F.explode(nodes).alias("node"), "s").groupBy("key", "level", "node").agg(F.min("s").alias("s"))
        above = questions.withColumn("level", level).withColumn("node", F.floor(F.col("leaf") / size))
        found = found.union(above.join(blocks, ["key", "level", "node"]).select("component", "rank", "s"))
    return found.groupBy("component", "rank").agg(F.min("s").alias("s"))


# Evidence that counts once in a group: a letter for its kind, and a digest whose first bytes are two short hashes.
KINDS = {"doc": b"d", "amendment": b"a", "described": b"t"}
HALVES = (2, 7)  # where the two begin, counted from 1, and their length
HALF = 5  # bytes; sums of so short hashes stay within 64 bits


def item_column(kind: str, value: Column) -> Column:
    return F.concat(F.lit(KINDS[kind]), F.unhex(F.md5(value)))


def item_parts(item: Column) -> dict[str, Column]:
    """Kind, item and hashes as ``fold_members`` wants them."""
    kind = F.when(F.substring(item, 1, 1) == F.lit(KINDS["doc"]), "doc").otherwise("other")
    a, b = (F.conv(F.hex(F.substring(item, h, HALF)), 16, 10).cast("long") for h in HALVES)
    return {"kind": kind, "item": item, "a": a, "b": b}


def document_set(items: Column) -> Column:
    """A set of documents as its size and sums of hashes, which can be added up; null without documents."""
    docs = F.filter(items, lambda i: item_parts(i)["kind"] == "doc")
    hashes = F.transform(docs, lambda i: F.struct(*[c.alias(name) for name, c in item_parts(i).items()]))
    total = [F.aggregate(hashes.getField(f), F.lit(0).cast("long"), lambda t, x: t + x) for f in ("a", "b")]
    return F.when(F.size(docs) > 0, F.concat_ws(":", F.size(docs).cast("string"), *[t.cast("string") for t in total]))


@lru_cache(100_000)
def _hashes(item: bytes) -> tuple[int, int] | None:
    """The two short hashes of a document."""
    if item[:1] != KINDS["doc"]:
        return None
    a, b = (int.from_bytes(item[h - 1 : h - 1 + HALF], "big") for h in HALVES)
    return a, b


# Records of a component as rows, in order of their places.
RECORD = ["component", "notice_key", "ordinal", "id", "tkey", "authority", "day", "title", "url", "reference", "item", "role",
          "standing", "observed", "items"]
Record = NamedTuple("Record", [(name, object) for name in RECORD])
ANY, NONE = "*", "-"  # stand in keys for any value, and for a missing one
OPPOSITE = {"portal": "mirror", "mirror": "portal"}


def _under(value: str | None) -> tuple[str, str]:
    """What a survivor is found by."""
    return (ANY, NONE) if value is None else (ANY, "=" + value)


def _wanted(value: str | None) -> tuple[str, ...]:
    """What a record asks for: a missing value matches any."""
    return (ANY,) if value is None else ("=" + value, NONE)


def _keys_of(r: Record, role: str | None, others: tuple[str, ...], of: Callable, docs: tuple[str, ...]) -> list[tuple]:
    """Keys by each clause of the match rule, with each choice of what may be missing; as in ``dedupe.offered_keys``."""
    keys: list[tuple] = []
    if r.tkey is not None:
        keys.append(("t", r.tkey))
    if r.id is not None:
        keys += [("i", r.id, o) for o in others]
    if r.title is None:
        return keys
    if role is not None and r.item is not None:
        keys.append(("p", role, r.item, r.title))
    if r.url is not None:
        keys += [("u", r.url, r.title, o, a, d) for o in others for a in of(r.authority) for d in of(r.day)]
    if r.reference is not None and r.authority is not None:
        keys += [("r", r.reference, r.title, r.authority, o, d, x) for o in others for d in of(r.day) for x in docs]
    return keys


def offered(r: Record, docs: str | None) -> list[tuple]:
    """Keys under which a survivor with these documents can be found while ``r`` is its best record."""
    return _keys_of(r, r.role, _under(r.tkey)[: 1 + (r.tkey is None)], _under, _under(docs))


def asked(r: Record, docs: str | None) -> list[tuple]:
    """Keys that a record with these documents looks its survivor up by."""
    return _keys_of(r, OPPOSITE.get(r.role), (ANY,) if r.tkey is None else (NONE,), _wanted, _wanted(docs))


def _told(n: int, a: int, b: int) -> str | None:
    return f"{n}:{a}:{b}" if n else None


class Survivor:
    """A group as it stands: its best record, and the evidence that its members have brought."""

    def __init__(self):
        self.best: Record | None = None
        self.size = self.first_own = 0
        self.seen: set[bytes] = set()
        self.sums = (0, 0, 0)
        self.docs: str | None = None
        self.shown: tuple | None = None  # best record and documents that its keys were made of
        self.keys: frozenset[tuple] = frozenset()

    def join(self, new: Record, docs: str | None) -> bool:
        """Whether the new member, which has these documents, became the best."""
        gathered, own = self.first_own if self.size == 1 else len(self.seen), len(new.items)
        won = outranks(new.standing, self.best.standing if self.best else "")
        if won is None:
            won = new.observed > self.best.observed or (
                new.observed == self.best.observed and wins_tie(new.standing, own, self.best.standing, gathered)
            )
        if won:
            self.best = new
        n, a, b = self.sums
        for i in new.items:
            if i not in self.seen:
                self.seen.add(i)
                if (hashes := _hashes(i)) is not None:
                    n, a, b = n + 1, a + hashes[0], b + hashes[1]
        self.sums = n, a, b
        if self.size == 0:
            self.first_own, self.docs = own, docs
        else:
            self.docs = _told(n, a, b)
        self.size += 1
        return won


def place_in_order(records: list[Record]) -> list[tuple]:
    """(notice_key, ordinal, grp, survivor_key, won) of a component's records, each placed with the first survivor it meets."""
    survivors: list[Survivor] = []
    under: dict[tuple, list[int]] = {}  # survivors by key, the first on top; some have left the key since
    placed = []
    for record in records:
        hashes = [h for i in record.items if (h := _hashes(i)) is not None]
        docs = _told(len(hashes), sum([a for a, _ in hashes]), sum([b for _, b in hashes])) if hashes else None
        found = len(survivors)
        for key in asked(record, docs):
            there = under.get(key)
            while there and key not in survivors[there[0]].keys:
                heapq.heappop(there)
            if there and there[0] < found:
                found = there[0]
        if found == len(survivors):
            survivors.append(Survivor())
        joined = survivors[found]
        placed.append((record.notice_key, record.ordinal, found, joined.join(record, docs)))
        best, shown = joined.best, joined.shown
        if shown is None or best is not shown[0] or (joined.docs != shown[1] and best.reference is not None):
            before, joined.shown = joined.keys, (best, joined.docs)
            joined.keys = frozenset(offered(best, joined.docs))
            for key in joined.keys - before:
                if (there := under.get(key)) is None:
                    under[key] = [found]
                else:
                    heapq.heappush(there, found)
    return [(k, o, f"{records[0].component:X}/{s}", survivors[s].best.notice_key, won) for k, o, s, won in placed]


def place_components(records: DataFrame) -> DataFrame:
    """(notice_key, ordinal, grp, survivor_key, won) of records (``RECORD``) whose components each fit one task's memory.

    A partition must hold its components whole, sorted by component and place.
    """
    kind = records.schema["notice_key"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        first = next(batches, None)
        if first is None:
            return
        key = first.schema.field("notice_key").type
        schema = pa.schema([("notice_key", key), ("ordinal", pa.int64()), ("grp", pa.string()), ("survivor_key", key), ("won", pa.bool_())])
        for run in runs_of(chain([first], batches), 1):
            out += place_in_order([Record(*r) for r in run])
            if len(out) >= LEAF_ROWS:
                yield _batch(out, schema)
                out = []
        yield _batch(out, schema)

    return records.select(*RECORD).mapInArrow(place, f"notice_key {kind}, ordinal long, grp string, survivor_key {kind}, won boolean")
