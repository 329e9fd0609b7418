import random

from noticemill.operators import ordered_fold as of
from noticemill.operators.ordered_fold import Member, describe, first_matches, fold_members, replay


def kind(rng):
    flags = ["1" if rng.random() < p else "0" for p in (0.05, 0.3, 0.4, 0.2, 0.3, 0.5)]
    return of.SEPARATOR.join([*flags, rng.choice(["", "portal", "mirror"]), rng.choice(["", "x"])])


def group(rng, n, kinds):
    """Members of one group with what each adds; times tie often."""
    held, out = set(), []
    for i in range(n):
        docs = rng.sample(range(6), rng.randrange(3))
        new = [d for d in docs if d not in held]
        held.update(docs)
        out.append(dict(grp="g", at=10 * i, sig=f"s{rng.randrange(3)}", standing=rng.choice(kinds), observed=rng.choice([-(2**62), 1, 2, 3]),
                        own=len(docs), raw_docs=f"{len(docs)}:r" if docs else "", new_q=len(new), new_n=len(new), new_a=sum(new), new_b=7 * len(new)))
    return out


def chunked(rows, size):
    """The members with their chunk and what the chunks before it have gathered."""
    out = []
    for lo in range(0, len(rows), size):
        before, part = rows[:lo], rows[lo : lo + size]
        prior = {f"prior_{c}": sum(r[f"new_{c}"] for r in before) for c in "qnab"}
        next_at = rows[lo + size]["at"] if lo + size < len(rows) else None
        out.append([Member(**r, leaf=lo // size, **prior, prior_rows=lo, first_own=rows[0]["own"], next_at=next_at) for r in part])
    return out


def plain(rows):
    """Best record and documents after each member, one by one."""
    best, out, n, a, b, q = None, [], 0, 0, 0, 0
    for i, m in enumerate(rows):
        rule = of.outranks(m["standing"], best["standing"]) if best else True
        gathered = rows[0]["own"] if i == 1 else q
        if rule is None:
            rule = m["observed"] > best["observed"] or (
                m["observed"] == best["observed"] and of.wins_tie(m["standing"], m["own"], best["standing"], gathered)
            )
        best = m if rule else best
        n, a, b, q = n + m["new_n"], a + m["new_a"], b + m["new_b"], q + m["new_q"]
        out.append((m["at"], rule, best["at"], m["raw_docs"] if not i else f"{n}:{a}:{b}" if n else "", best["sig"]))
    return out


def test_chunks_told_as_functions_give_the_plain_fold():
    rng = random.Random(4)
    for trial in range(300):
        kinds = [kind(rng) for _ in range(rng.randrange(1, 8))]
        rows = group(rng, rng.randrange(1, 40), kinds)
        wanted, state, got = plain(rows), (None, "", 0, None), []
        for members in chunked(rows, rng.choice([1, 2, 5, 40])):
            got += replay(members, state)
            by_kind = {k: (bounds, last) for k, bounds, last in describe(members, ["", *kinds])}
            steps = of.Outcomes()
            steps.bounds, steps.last = by_kind[state[1]]
            place = steps.of(state[2])
            if place is not None:
                m = members[place]
                state = (m.at, m.standing, m.observed, m.sig)
            assert state[0] == got[-1][3]
        assert [(at, won, best, docs) for _, at, won, best, docs, _ in got] == [w[:4] for w in wanted]
        # A state begins where identity or documents change, and each lasts until the next one.
        starts = [(r[1], r[5]) for r in got if r[5] is not None]
        assert [u for _, u in starts] == [*[at for at, _ in starts[1:]], 2**62]
        changes = [w[0] for i, w in enumerate(wanted) if not i or w[3:] != wanted[i - 1][3:]]
        assert set(changes) <= {at for at, _ in starts}


def test_fold_over_chunks_equals_fold_in_one(spark):
    rng = random.Random(6)
    members, items = [], []
    for g in range(6):
        kinds = [kind(rng) for _ in range(4)]
        for i in range(rng.randrange(1, 30)):
            docs = [rng.randrange(5) for _ in range(rng.randrange(3))]
            raw = f"{len(docs)}:{sum(docs)}:{sum(7 * d for d in docs)}" if docs else ""
            members.append((f"g{g}", i // 4, i, f"s{rng.randrange(3)}", rng.choice(kinds), rng.randrange(3), len(docs), raw))
            items += [(f"g{g}", i, "doc", str(d), d, 7 * d) for d in docs]
    m = spark.createDataFrame(members, "grp string, leaf long, at long, sig string, standing string, observed long, own long, raw_docs string")
    t = spark.createDataFrame(items, "grp string, at long, kind string, item string, a long, b long")
    many = sorted(tuple(r)[:5] for r in fold_members(m, t).collect())
    one = sorted(tuple(r)[:5] for r in fold_members(m.withColumn("leaf", m["leaf"] * 0), t, several=False).collect())
    assert many == one and len(one) == len(members)


def test_first_matches_as_of_a_rank(spark):
    rng = random.Random(7)
    n, states, asked = 90, [], []
    for s in range(40):
        at = s
        while at < n - 1:
            until = rng.choice([at + rng.randrange(1, 6), at + rng.randrange(1, 60), 2**62])
            states.append(("c", s, at, until, n - 1, [f"k{rng.randrange(5)}"]))
            at = until
    asked = [("c", r, rng.sample([f"k{i}" for i in range(7)], 2)) for r in range(n)]
    wanted = {}
    for _, s, since, until, _, keys in states:
        for _, rank, wants in asked:
            if since < rank <= until and set(keys) & set(wants):
                wanted[rank] = min(wanted.get(rank, s), s)
    given = spark.createDataFrame(states, "component string, s long, since long, until long, last long, keys array<string>")
    asks = spark.createDataFrame(asked, "component string, rank long, keys array<string>")
    for leaf_rows in (3, 1000):
        assert {r["rank"]: r["s"] for r in first_matches(given, asks, n - 1, leaf_rows).collect()} == wanted
