from noticemill.llm.line_dedup import line_dedup

from .cases import LONG, documents, empty, table, texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute(rows, least=2):
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(LONG if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < least or min(holders[key(x)]) == (LONG if i is None else i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_matches_brute_force(spark):
    found = sorted((tuple(r) for r in line_dedup(documents(spark)).collect()), key=repr)
    assert found == brute(texts())
    assert any(r[3] for r in found)


def test_higher_threshold(spark):
    found = sorted((tuple(r) for r in line_dedup(documents(spark), min_documents=4).collect()), key=repr)
    assert found == brute(texts(), 4)


def test_limits_of_a_key(spark):
    rows = [(1, "123456789\nÉÉÉÉÉÉÉÉÉÉ\nSAME line xx"), (2, "123456789\nÉÉÉÉÉÉÉÉÉÉ\n\x0bsame LINE xx \r"), (3, "éééééééééé")]
    assert sorted((tuple(r) for r in line_dedup(table(spark, rows)).collect()), key=repr) == brute(rows)


def test_empty_table_and_carried_columns(spark):
    assert line_dedup(empty(spark)).collect() == []
    rows = line_dedup(table(spark, [(1, "a\nb")]), carry=["n_lines", "key_", "lang"]).collect()
    assert [tuple(r) for r in rows] == [(1, "a\nb", 2, 0, "clash", "clash", None)]
