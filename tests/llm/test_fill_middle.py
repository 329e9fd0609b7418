import hashlib

from noticemill.llm.fill_middle import fill_in_middle, rebuilt

from .cases import documents, empty, table, texts


def brute(rows, percent=90):
    out = []
    for i, text in rows:
        t = text or ""
        n = len(t)
        digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
            out.append((i, n, "plain", None, None, t))
        elif h[3] % 100 < 20:
            out.append((i, n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"))
        else:
            out.append((i, n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"))
    return sorted(out, key=repr)


def check(spark, rows, df, percent=90):
    found = fill_in_middle(df, percent=percent)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows, percent)
    back = found.select("doc_id", rebuilt(found["output"], found["form"]))
    assert sorted((tuple(r) for r in back.collect()), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)


def test_matches_brute_force(spark):
    check(spark, texts(), documents(spark))
    check(spark, texts(), documents(spark), percent=100)


def test_markers_and_pieces_of_markers(spark):
    rows = [(i, t) for i, t in enumerate(["a <P> b", "<S>", "x<M", "<", "<P", "S>", ">", "<<P", "$1\\2$", "<p>"] * 12)]
    check(spark, rows, table(spark, rows), percent=100)


def test_units_are_code_points_in_texts_of_any_length(spark):
    rows = [(i, "a🦆é\r\n é" * i) for i in (0, 1, 36, 37, 73, 74, 300)]
    rows += [(1000 + i, "🦆" * n) for i, n in enumerate((255, 256, 257, 511, 512, 513))]
    rows += [(2000, "long 🦆\n" * 200_000), (2001, "퟿" * 70_000)]
    check(spark, rows, table(spark, rows), percent=100)


def test_all_forms_occur_and_repeated_rows_stay(spark):
    rows = [(i, f"text number {i}") for i in range(300)] + [(7, "text number 7")] * 2 + [(7, "other")]
    df = table(spark, rows)
    check(spark, rows, df)
    assert {r.form for r in fill_in_middle(df).select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert fill_in_middle(empty(spark)).collect() == []


def test_plan_has_no_shuffle_and_no_python(spark):
    plan = fill_in_middle(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange") == 1  # the fixture's own repartition
