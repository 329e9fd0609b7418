import random

from pyspark.sql import functions as F

from noticemill.operators import selection as sel
from noticemill.operators.ranking import chunked_row_number


def brute_round_robin(rows, limit, cursors):
    """rows: [(key, groups)] in order."""
    groups = {}
    for key, names in rows:
        for g in names or ["GENERIC"]:
            groups.setdefault(g, []).append(key)
    queues = []
    for g, keys in groups.items():
        o = cursors.get(g, 0) % len(keys)
        queues.append(keys[o:] + keys[:o])
    taken = []
    while len(taken) < limit:
        before = len(taken)
        for q in queues:
            while q and q[0] in taken:
                q.pop(0)
            if q:
                taken.append(q.pop(0))
            if len(taken) == limit:
                break
        if len(taken) == before:
            break
    return taken


def test_fair_selection_equals_the_replay(spark):
    rng = random.Random(3)
    data = {s: [(i * 3 + n, rng.sample(["A", "B", "C"], rng.randrange(3))) for i in range(size)] for n, (s, size) in enumerate([("s1", 300), ("s2", 7), ("s3", 40)])}
    rows = [(s, k, k, g) for s, items in data.items() for k, g in items]
    df = spark.createDataFrame(rows, "source_id string, notice_key int, ordinal int, priority_categories array<string>")
    cursors = {"A": 250, "B": 5, "GENERIC": 1}
    c = spark.createDataFrame([(s, g, n) for s in data for g, n in cursors.items()], "source_id string, grp string, next int")
    for cur, frame in (({}, None), (cursors, c)):
        out = sel.fair_selection(df, cursors=frame, chunk=F.floor(F.col("ordinal") / 50)).collect()
        for s, items in data.items():
            got = [r.notice_key for r in sorted(out, key=lambda r: r.position) if r.source_id == s]
            assert got == brute_round_robin(items, 16, cur)
    chosen = sel.fair_selection(df)
    assert sel.deferred(df, chosen).count() == len(rows) - chosen.count()


def test_distributed_row_numbers(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 == 0, None).otherwise("g").alias("g"))
    got = {(r.id): (r["rank"], r.rank_of) for r in chunked_row_number(df, ["g"], [F.asc("id")], F.floor(F.col("id") / 70)).collect()}
    for null in (True, False):
        ids = [i for i in range(1000) if (i % 3 == 0) == null]
        assert [got[i] for i in ids] == [(n + 1, len(ids)) for n in range(len(ids))]


def test_term_plan(spark):
    terms = sel.search_terms(spark)
    plans = [[(r.grp, r.term) for r in sel.term_plan(terms, b).collect()] for b in (0, 1)]
    assert len({g for g, _ in plans[0][:13]}) == 13 and plans[0][0][0] == "VENTILATORS" and plans[1][0][0] == "ULTRASOUND"
    assert set(plans[0]) == set(plans[1]) and len(plans[0]) == len(set(plans[0]))


def test_interleave_is_fair_and_reaches_every_row(spark):
    rows = [(i, i, "Punjab", "A") for i in range(300)] + [(300, 300, "Haryana", "A"), (301, 301, "UNLOCATED", "B")]
    df = spark.createDataFrame(rows, "notice_key int, ordinal int, region_queue string, grp string")
    order = ["Punjab", "Haryana", "UNLOCATED"]
    out = [r.region_queue for r in sel.interleave(df, order).orderBy("position").collect()]
    assert len(out) == 302 and set(out[:3]) == set(order)
    one = spark.createDataFrame([(i, i, "Punjab", "A") for i in range(63)], "notice_key int, ordinal int, region_queue string, grp string")
    seen = set()
    for bucket in range(0, 63, 4):
        seen |= {r.notice_key for r in sel.interleave(one, order, bucket).orderBy("position").limit(5).collect()}
    strided = {(b * 22 + k) % 63 for b in range(0, 63, 4) for k in range(5)}
    assert seen == strided and spark.range(1).select(sel._stride(F.lit(63), 13)).first()[0] == 22
    assert {(b * 22 + k) % 63 for b in range(63) for k in range(5)} == set(range(63))


def test_ranks_windows_and_document_order(spark):
    df = spark.createDataFrame([(False, ["A"], True), (True, ["A"], True), (True, [], True), (True, [], False)], "c boolean, g array<string>, x boolean").coalesce(1)
    assert [r[0] for r in df.select(sel.priority_rank(F.col("c"), F.col("g"), F.col("x"))).collect()] == [-1, 3, 2, 0]
    names = spark.createDataFrame([(n, i) for i, n in enumerate("abcdefgh")], "name string, ordinal int").coalesce(1)
    pinned = F.col("name").isin("c", "e", "g")
    assert [r.name for r in sel.organisation_window(names, 2, pinned).collect()] == ["c", "e", "d", "f", "g", "h"]
    docs = spark.createDataFrame([(1, i, t) for i, t in enumerate(["tender-document", "boq", "technical-specification", "corrigendum", "boq"])], "notice_key int, ordinal int, doc_type string")
    assert [r.ordinal for r in sel.document_order(docs, 4).orderBy("position").collect()] == [3, 2, 1, 4]
    dept = spark.createDataFrame([("Health Department Punjab",), ("Military stores",), ("Roads",)], "department string").coalesce(1)
    assert [r[0] for r in dept.select(sel.local_evidence_score(dept)).collect()] == [100, 10, 0]
    assert [r.region_queue for r in sel.region_queue(dept).collect()] == ["Punjab", "UNLOCATED", "UNLOCATED"]


def test_listing_candidates(spark):
    df = spark.createDataFrame([("equipment", True), ("roads", True), ("equipment", False)], "title string, a boolean").coalesce(1)
    no = F.lit(False)
    got = sel.listing_candidates(df, F.col("a"), no, no, no).collect()
    assert [r.is_candidate for r in got] == [True, False, False]
    assert all(r.is_candidate for r in sel.listing_candidates(df, F.col("a"), no, no, F.lit(True)).collect())
