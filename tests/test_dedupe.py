import itertools
import os
import random
import re
from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from noticemill.operators import dedupe as dd
from noticemill.operators.components import connected_components, contracted_components
from noticemill.operators.status import resolve_status
from noticemill.plans.lineage import Scratch, cut, shared_folder

from .helpers import notices, now


def merged(spark, *rows):
    gold = resolve_status(notices(spark, *rows), now())
    return dd.deduplicate(gold, now())


def survivors(spark, *rows):
    return merged(spark, *rows).with_provenance().orderBy("ordinal").collect()


def tagged(row, tag):
    return {**row, "id": f"{row['id']}{tag}", "tender_id": f"{row['tender_id'].strip()}{tag}"}


def both_orders(spark, *pairs):
    """Every pair in both input orders, each under its own ids, in one run."""
    rows = []
    for n, (a, b) in enumerate(pairs):
        rows += [tagged(a, f"{n}1"), tagged(b, f"{n}1"), tagged(b, f"{n}2"), tagged(a, f"{n}2")]
    out = survivors(spark, *rows)
    assert len(out) == 2 * len(pairs)
    return out


def test_same_id_across_sources_keeps_the_ended_row(spark):
    a = {"id": "x", "tender_id": "T1", "source_id": "s1"}
    b = {"id": "x", "tender_id": " t1 ", "source_id": "s2", "cancelled": True, "fetched_at": "2026-09-29T11:00:00Z"}
    for r in both_orders(spark, (a, b)):
        assert r.status == "CANCELLED" and len(r.source_references) == 2


def test_reference_rules(spark):
    base = {"reference_number": "R/1", "organisation": "Org"}
    rows = [
        {"id": "a", **base}, {"id": "b", **base, "reference_number": "r-1"},
        {"id": "c", **base, "publish_date": "2026-08-01"},
        {"id": "d", **base, "reference_number": "R/2", "documents": [("x", "u1")]},
        {"id": "e", **base, "reference_number": "R/2", "documents": [("x", "u2")]},
        {"id": "f", **base, "organisation": "Other"},
        {"id": "g", **base, "reference_number": "R/3", "tender_id": "T1"}, {"id": "h", **base, "reference_number": "R/3", "tender_id": "T2"},
    ]
    out = merged(spark, *rows)
    groups = {}
    for m in out.members.collect():
        groups.setdefault(m.survivor_key, set()).add(m.notice_key)
    assert sorted(map(sorted, groups.values())) == [[0, 1], [2], [3], [4], [5], [6], [7]]


def test_urls_that_name_one_document(spark):
    listing, pdf = "https://a.gov.in/list", "https://a.gov.in/x.pdf"
    rows = [{"id": "a", "tender_url": listing}, {"id": "b", "tender_url": listing}, {"id": "c", "tender_url": pdf, "title": "Bed!"},
            {"id": "d", "tender_url": pdf, "title": "bed"}, {"id": "e", "tender_url": pdf, "title": "other"}]
    assert [r.member_count for r in survivors(spark, *rows)] == [1, 1, 2, 1]


def test_malformed_observation_never_wins(spark):
    good = {"id": "x", "tender_id": "T", "documents": [("a", "u1")]}
    bad = {"id": "x", "tender_id": "T", "fetched_at": "later", "documents": [("b", "u2"), ("c", "u1")]}
    for r in both_orders(spark, (good, bad)):
        assert r.fetched_at != "later"
        assert [d.url for d in r.documents] == ["u1", "u2"]


def test_older_evidence_is_kept_with_the_newer_deadline(spark):
    old = {"id": "x", "tender_id": "T", "fetched_at": "2026-09-29T11:00:00Z", "description": "scope",
           "corrigenda": [("Extension", None, "2026-09-02", "2026-10-03", None)]}
    new = {"id": "x", "tender_id": "T", "original_closing_date": "2026-10-09"}
    for r in both_orders(spark, (old, new)):
        assert r.effective_closing_date == "2026-10-09" and r.description == "scope" and len(r.corrigenda) == 1


INDEX = {"id": "x", "tender_id": "GEM/2026/B/1", "source_id": "gem-direct-punjab", "original_closing_date": None,
         "extended_closing_date": "2026-10-05T15:00:00+05:30", "fetched_at": "2026-09-30T08:00:00Z"}
MIRROR = {"id": "x", "tender_id": "GEM/2026/B/1", "source_id": "hospital", "original_closing_date": "2026-10-02T15:00:00+05:30"}


def test_live_index_beats_a_later_mirror(spark):
    weak = [{"stale": True}, {"fetched_at": "2026-09-28T08:00:00Z"}, {"fetched_at": None}]
    pairs = [(INDEX, MIRROR), *[({**INDEX, **w}, MIRROR) for w in weak]]
    for r in both_orders(spark, *pairs):
        wanted = "gem-direct-punjab" if r.tender_id[len("GEM/2026/B/1")] == "0" else "hospital"
        assert r.source_id == wanted


def test_portal_and_mirror_items(spark):
    portal = [{"id": f"p{i}", "tender_id": f"2026_PGIME_{i}_1", "source_id": "cppp-pgimer", "institution_id": "pgimer", "title": f"Item {i}",
               "reference_number": f"PI(EP)/25-26/G/14/0{i}", "verification": "detail", "publish_date": "2026-09-02",
               "original_closing_date": "2026-10-05T15:00:00+05:30"} for i in range(1, 5)]
    mirror = [{"id": f"m{i}", "source_id": "pgimer-notices", "institution_id": "pgimer", "title": f"item {i}", "publish_date": "2026-08-30",
               "reference_number": f"E-Tender Notice No. PI(EP)/25-26/G/14/0{i}", "fetched_at": "2026-09-30T11:30:00Z"} for i in range(1, 5)]
    mixed = [portal[0], portal[1], mirror[2], mirror[3], mirror[0], mirror[1], portal[2], portal[3]]
    changes = ({"reference_number": "PI(EP)/25-26/G/14/09"}, {"title": "else"}, {"institution_id": "gmch"}, {"source_id": "s"})
    apart = [{**mirror[0], **c, "id": f"a{i}"} for i, c in enumerate(changes)]
    out = survivors(spark, *mixed, *apart)
    assert len(out) == 8
    assert {r.source_id for r in out[:4]} == {"cppp-pgimer"} and all(len(r.source_references) == 2 for r in out[:4])


FIELDS = ("fetched_at", "verification", "description", "documents", "corrigenda", "status", "source_id", "stale")


def plain(text):
    return re.sub("[^a-z0-9]", "", (text or "").lower())


def item(row):
    found = re.fullmatch(r"(?:(?:E-Tender|Global Tender Enquiry)\s+Notice\s+No\.?\s*)?(PI\(EP\)/\d{2}-\d{2}/(?:G/)?\d+/\d+)", (row.reference_number or "").strip(), re.I)
    return found and found[1].upper()


def pair(a, b):
    portal = next((r for r in (a, b) if r.source_id == "cppp-pgimer"), None)
    mirror = next((r for r in (a, b) if r.source_id == "pgimer-notices"), None)
    return bool(
        portal and mirror and portal.institution_id == mirror.institution_id == "pgimer" and not mirror.tender_id
        and re.fullmatch(r"20\d{2}_PGIME_\d+_\d+", portal.tender_id or "", re.I)
        and item(portal) and item(portal) == item(mirror) and plain(portal.title) == plain(mirror.title)
    )


def same(a, b):
    if a.tender_id and b.tender_id:
        return a.tender_id.strip().lower() == b.tender_id.strip().lower()
    if a.id == b.id:
        return True
    x, y = (plain(r.institution_id or r.organisation or r.buyer) for r in (a, b))
    if x and y and x != y:
        return False
    if pair(a, b):
        return True
    if a.publish_date and b.publish_date and a.publish_date[:10] != b.publish_date[:10]:
        return False
    titles = plain(a.title) == plain(b.title)
    if titles and a.tender_url and a.tender_url == b.tender_url and a.tender_url.endswith(".pdf"):
        return True
    if a.reference_number and b.reference_number and plain(a.reference_number) == plain(b.reference_number) and x and y:
        u, v = ("|".join(sorted(d.url for d in r.documents or [])) for r in (a, b))
        return titles and not (u and v and u != v)
    return False


def seen(row):
    text = row.checked_at or row.fetched_at
    return datetime.fromisoformat(text.replace("Z", "+00:00")).timestamp() if text and text[:2] == "20" else float("-inf")


def ordered_merge(rows, clock):
    """The ordered rule as a loop over whole records."""
    soon = lambda r: -300 <= clock - seen(r) <= 86_400
    index = lambda r: bool(re.match("gem-direct(-|$)|gem-priority-keywords$", r.source_id) and re.fullmatch(r"GEM/20\d{2}/[BR]/\d+", r.tender_id or "", re.I))
    kept = []
    for row in rows:
        at = next((i for i, k in enumerate(kept) if same(k, row)), None)
        if at is None:
            kept.append(SimpleNamespace(**{**vars(row), "members": [row.notice_key]}))
            continue
        old = kept[at]
        score = lambda r: 10 * (r.verification == "detail") + len(r.documents or []) + len(r.corrigenda or []) + bool(r.description)
        ended = lambda r: r.status in ("CANCELLED", "WITHDRAWN")
        direct = [index(r) and not r.stale and bool(r.extended_closing_date) and soon(r) for r in (row, old)]
        portal = [pair(row, old) and r.source_id == "cppp-pgimer" and r.verification == "detail" and not r.stale and bool(r.effective_closing_date) and soon(r) for r in (row, old)]
        if ended(row) != ended(old):
            wins = ended(row)
        elif (index(row) or index(old)) and bool(row.stale) != bool(old.stale):
            wins = not row.stale
        elif portal[0] != portal[1]:
            wins = portal[0]
        elif direct[0] != direct[1]:
            wins = direct[0]
        else:
            wins = (seen(row), score(row)) > (seen(old), score(old))
        best, other = (row, old) if wins else (old, row)
        unique = lambda values, key: list({key(v): v for v in reversed(values)}.values())[::-1]
        spec = lambda r: r.specification and any(d.status == "parsed" for d in r.specification.document_sources)
        kept[at] = SimpleNamespace(**{
            **vars(best), "members": [*old.members, row.notice_key],
            "description": best.description or other.description, "work_category": best.work_category or other.work_category,
            "specification": best.specification if spec(best) else other.specification or best.specification,
            "documents": unique([*(best.documents or []), *(other.documents or [])], lambda d: d.url),
            "corrigenda": unique([*(best.corrigenda or []), *(other.corrigenda or [])], lambda c: tuple(c)),
        })
    return {
        (k.notice_key, frozenset(k.members), k.description, k.work_category, k.specification and k.specification.name,
         frozenset(d.url for d in k.documents or []), frozenset(map(tuple, k.corrigenda or [])))
        for k in kept
    }


EXTRA = {"work_category": "string", "specification": "struct<name:string,document_sources:array<struct<status:string>>>"}


def merged_rows(gold, leaf_rows):
    out = dd.deduplicate(gold, now(), leaf_rows)
    groups = {}
    for m in out.members.collect():
        groups.setdefault(m.survivor_key, set()).add(m.notice_key)
    lists = {r.notice_key: r for r in out.with_provenance().collect()}
    assert set(lists) == set(groups)
    return {
        (k, frozenset(v), lists[k].description, lists[k].work_category, lists[k].specification and lists[k].specification.name,
         frozenset(d.url for d in lists[k].documents or []), frozenset(map(tuple, lists[k].corrigenda or [])))
        for k, v in groups.items()
    }


def mirrors(rng, n, ids, titles, times):
    """Random mirrors: shared ids, references, addresses, vetoes by documents, day and authority, index and portal rows."""
    rows = []
    for _ in range(n):
        kind = rng.random()
        row = {
            "id": f"i{rng.randrange(ids)}",
            "tender_id": rng.choice([None, None, f"T{rng.randrange(ids // 4)}"]),
            "title": f"t{rng.randrange(titles)}",
            "tender_url": rng.choice(["https://a.gov.in/list", f"https://a.gov.in/{rng.randrange(titles)}.pdf"]),
            "reference_number": rng.choice([None, f"R/{rng.randrange(titles)}", f"r-{rng.randrange(titles)}", "--"]),
            "organisation": rng.choice(["o1", "O-1", "o2", None]),
            "publish_date": rng.choice(["2026-09-01", "2026-09-02", None]),
            "stale": rng.random() < 0.3,
            "cancelled": rng.random() < 0.05,
            "verification": rng.choice(["listing", "listing", "detail"]),
            "fetched_at": rng.choice([f"2026-09-30T{rng.randrange(times):02d}:00:00Z", f"2026-09-{rng.randrange(10, 30)}T05:00:00Z", "never"]),
            "documents": rng.choice([None, None, [("d", f"u{rng.randrange(3)}") for _ in range(rng.randrange(1, 4))]]),
            "corrigenda": rng.choice([None, None, [("Extension", None, "2026-09-02", None, f"c{rng.randrange(3)}")]]),
            "description": rng.choice([None, None, f"desc {rng.random()}"]),
            "work_category": rng.choice([None, None, None, f"work {rng.random()}"]),
            "specification": rng.choice([None, None, (f"spec {rng.random()}", [(rng.choice(["parsed", "failed"]),)])]),
            "source_id": "s1",
        }
        if kind < 0.2:
            row |= {"source_id": "gem-direct", "tender_id": f"GEM/2026/B/{rng.randrange(ids // 8 + 1)}", "extended_closing_date": rng.choice([None, "2026-10-09"])}
        elif kind < 0.4:
            row |= {"institution_id": "pgimer", "reference_number": f"PI(EP)/25-26/G/14/{rng.randrange(titles)}", "title": f"t{rng.randrange(2)}"}
            portal = rng.random() < 0.5
            row |= {"source_id": "cppp-pgimer" if portal else "pgimer-notices", "tender_id": f"2026_PGIME_{rng.randrange(ids)}_1" if portal else None}
        rows.append(row)
    return rows


def whole(gold):
    return [SimpleNamespace(**{"checked_at": None, **r.asDict()}) for r in gold.orderBy("ordinal").collect()]


CLOCK = datetime.fromisoformat("2026-09-30T12:00:00+05:30").timestamp()


@pytest.mark.parametrize("seed, n, ids, titles, times, leaf_rows", [(8, 150, 40, 3, 2, 10_000), (9, 40, 16, 2, 3, 8)])
def test_merge_equals_the_ordered_rule_on_random_mirrors(spark, seed, n, ids, titles, times, leaf_rows):
    """Few ids and titles make large mixed groups; few times make ties; small chunks make groups of several of them."""
    gold = cut(resolve_status(notices(spark, *mirrors(random.Random(seed), n, ids, titles, times), **EXTRA), now()))
    assert merged_rows(gold, leaf_rows) == ordered_merge(whole(gold), CLOCK)


def test_small_components_are_placed_in_one_pass(spark, monkeypatch):
    """Components that fit a task need no rounds; keys that stand for two records go to the rounds."""
    gold = cut(resolve_status(notices(spark, *mirrors(random.Random(5), 60, 20, 2, 2), **EXTRA), now()))
    in_rounds = []

    def settle(*args):
        in_rounds.append(args)
        return settle_in_rounds(*args)

    settle_in_rounds = dd.settle_in_rounds
    monkeypatch.setattr(dd, "settle_in_rounds", settle)
    assert merged_rows(gold, 10_000) == ordered_merge(whole(gold), CLOCK)
    assert not in_rounds
    a, b = {"id": "x", "publish_date": "2026-09-01"}, {"id": "x", "tender_id": "T1"}
    twice = notices(spark, a, b, {"id": "x", "tender_id": "T2"}).withColumn("notice_key", F.least("notice_key", F.lit(1)))
    dd.deduplicate(resolve_status(twice, now()), now()).members.collect()
    assert in_rounds


def test_survivor_keeps_what_it_has_gathered_on_equal_times(spark):
    base = {"id": "x", "tender_id": "T"}
    rows = [{**base, "documents": [("a", "u1")]}, {**base, "documents": [("a", "u2")]}, {**base, "documents": [("a", "u3"), ("b", "u4")]}]
    assert [r.notice_key for r in survivors(spark, *rows)] == [0]
    assert [r.notice_key for r in survivors(spark, *rows[:1], rows[2])] == [1]


def test_a_later_best_record_replaces_a_filled_value(spark):
    base = {"id": "x", "tender_id": "T"}
    times = [{"fetched_at": f"2026-09-30T0{h}:00:00Z"} for h in range(4)]
    rows = [{**base, **times[0], "description": "a"}, {**base, **times[1], "description": "b"}, {**base, **times[2]}]
    assert [(r.notice_key, r.description) for r in survivors(spark, *rows)] == [(2, "b")]
    rows = [{**base, **times[2]}, {**base, **times[0], "description": "a"}, {**base, **times[1], "description": "b"}]
    assert [(r.notice_key, r.description) for r in survivors(spark, *rows)] == [(0, "a")]


def test_hot_group_of_copies_is_settled_by_aggregates(spark):
    """A third of all rows share one id; none of them reaches the ordered replay."""
    n = 3000
    df = spark.range(n).select(
        F.col("id").alias("notice_key"), F.col("id").alias("ordinal"),
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("T"), F.col("id").cast("string"))).alias("tender_id"),
        F.lit("t").alias("title"), F.lit("s").alias("source_id"), F.lit("ACTIVE_LIKELY").alias("status"),
        F.concat(F.lit("2026-09-30T0"), (F.col("id") % 7).cast("string"), F.lit(":00:00Z")).alias("fetched_at"),
    ).withColumn("id", F.sha2("tender_id", 256))
    out = dd.deduplicate(df, now())
    hot = out.survivors.filter("tender_id = 'HOT'").collect()
    assert len(hot) == 1 and hot[0].member_count == 1000 and hot[0].notice_key == 6
    assert out.survivors.count() == 2001


def test_components_over_long_chains(spark):
    edges = [(i, f"k{i // 2}") for i in range(40)] + [(i, f"j{(i + 1) // 2}") for i in range(40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "node int, key string")).collect()}
    assert set(got.values()) == {0} and len(got) == 40


def files_under(tops):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for top in tops for d, _, names in os.walk(top) for f in names}


def test_merge_leaves_only_its_members_on_disk(spark):
    """Neither the tables between its steps nor the shuffle files that made them stay, and a member takes few bytes."""
    n = 20_000
    key = lambda by: F.floor(F.col("id") / by).cast("string")
    df = spark.range(n).select(
        F.col("id").alias("notice_key"), F.col("id").alias("ordinal"), F.concat(F.lit("i"), key(2)).alias("id"),
        F.concat(F.lit("t"), key(12)).alias("title"), F.concat(F.lit("https://a.gov.in/"), key(4), F.lit(".pdf")).alias("tender_url"),
        F.concat(F.lit("R/"), key(3)).alias("reference_number"), F.lit("o").alias("organisation"), F.lit("s").alias("source_id"),
        F.lit("ACTIVE_LIKELY").alias("status"), F.lit("2026-09-30T01:00:00Z").alias("fetched_at"),
    )
    local = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    shuffled = lambda: {f for f in files_under(local) if os.path.basename(f).startswith("shuffle_")}
    folder = shared_folder(spark).removeprefix("file:")
    shuffles, kept = shuffled(), files_under([folder])
    out = dd.deduplicate(df, now())
    assert not shuffled() - shuffles
    new = {f: b for f, b in files_under([folder]).items() if f not in kept}
    assert not [f for f in new if f.endswith(".parquet")] and sum(new.values()) < 120 * n
    sizes = out.members.groupBy("survivor_key").count().select("count").distinct()
    assert [r[0] for r in sizes.collect()] == [4]  # by address; a survivor shows its own id and reference only


def test_records_without_an_id_are_connected_by_their_other_keys(spark):
    base = {"id": None, "reference_number": "R/1", "organisation": "o"}
    rows = [
        {"id": "a", "tender_id": "T1"}, {"id": None, "tender_id": "t1"}, {"id": None, "tender_id": "T2"}, {"id": "b", "tender_id": "T2"},
        base, {**base, "tender_id": "T3"}, {**base, "reference_number": None}, {**base, "reference_number": None}, {**base, "id": "c"},
    ]
    groups = {}
    for m in merged(spark, *rows).members.collect():
        groups.setdefault(m.survivor_key, set()).add(m.notice_key)
    assert sorted(map(sorted, groups.values())) == [[0, 1], [2, 3], [4, 5, 8], [6], [7]]


def test_contracted_components_of_hashes(spark):
    """Chains, stars, nodes that share nothing, and no edges at all."""
    chain = [(i, f"c{k}") for i in range(60) for k in (i // 2, 100 + (i + 1) // 2)]
    star = [(1000 + i, "hub") for i in range(200)] + [(1000 + i, f"own{i}") for i in range(200)]
    edges = [*chain, *star, *chain[:5], (5000, "lone"), (5001, "other")]
    df = spark.createDataFrame(edges, "node long, key string").select(F.xxhash64("node").alias("node"), F.xxhash64("key").alias("key"))
    hashed = {r.h: r.id for r in spark.range(6000).select("id", F.xxhash64("id").alias("h")).collect()}
    with Scratch(spark) as scratch:
        got = {}
        for r in contracted_components(df, scratch).collect():
            got.setdefault(r.root, set()).add(hashed[r.node])
        assert sorted(map(sorted, got.values())) == [list(range(60)), list(range(1000, 1200))]
        assert contracted_components(df.limit(0), scratch).isEmpty()


def test_retender_links(spark):
    rows = [
        {"title": "Supply of bed", "cancelled": True, "tender_id": "T1", "organisation": "o"},
        {"title": "Re-tender Supply of bed", "organisation": "o"},
        {"title": "Re-tender Supply of bed", "organisation": "p"},
        {"title": "Recalled pump", "organisation": None}, {"title": "Pump", "withdrawn": True, "organisation": None, "reference_number": "R9"},
        {"title": "Supply of bed", "organisation": "o"},
    ]
    got = {r.notice_key: r.replaces for r in dd.link_retenders(notices(spark, *rows), F.lit(True)).collect()}
    assert got == {0: None, 1: "T1", 2: None, 3: "R9", 4: None, 5: None}


def test_offered_and_asked_keys_agree_with_the_match_rule(spark):
    """A record asks for a key that a survivor offers just where the rule says that they are the same notice."""
    kinds = itertools.product([None, "t1", "t2"], ["a", "b"], [None, "o", "p"], [None, "2026-09-01", "2026-09-02"], ["x", "y"], [None, "R", "--"])
    docs = itertools.cycle([None, [("d", "u1")], [("d", "u2"), ("d", "u1")], None])
    rows = [dict(tender_id=t, id=i, organisation=o, publish_date=d, title=n, reference_number=r, documents=next(docs),
                 tender_url=f"https://a.gov.in/{n}.pdf" if r is None else "https://a.gov.in/list") for t, i, o, d, n, r in kinds]
    gold = resolve_status(notices(spark, *rows), now())
    ident = dd.identity_columns(gold, now()).withColumns({**dd.offered_keys(), "asked": dd.asked_keys()})
    keyed = ident.withColumn("offered", F.concat("fixed", dd.completed(F.col("refs"), F.col("docs"))))
    found = {r.notice_key: (set(r.offered), set(r.asked)) for r in keyed.select("notice_key", "offered", "asked").collect()}
    plain_rows = whole(gold)
    for a, b in random.Random(1).sample(list(itertools.product(range(len(rows)), repeat=2)), 20_000):
        wanted = same(plain_rows[a], plain_rows[b])
        assert bool(found[plain_rows[a].notice_key][0] & found[plain_rows[b].notice_key][1]) == wanted
