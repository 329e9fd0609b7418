import random
import re

from noticemill.llm import quality_rules as rules

from .cases import documents, empty, table, texts


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def check(spark, rows):
    found = rules.quality_rules(table(spark, rows)).collect()
    got = sorted((repr(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found)
    assert got == sorted((repr(i), *brute(t)) for i, t in rows)
    for r in found:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (r.rejected_by is None) and not (r.kept and r.base_failed)
    return found


def test_counts_match_brute_force(spark):
    check(spark, texts())
    rng = random.Random(9)
    check(spark, [(i, "\n".join(" ".join(rng.choice("abé") for _ in range(rng.randint(0, 30))) for _ in range(6))) for i in range(60)])


def test_order_never_changes_the_verdict():
    data = [(t or "").encode() for _, t in texts()] + [b"| a " * 40, b"WORD WORD%% " * 30, b"fine words in a row " * 9]
    for text in map(rules.measure, data):
        verdicts = set()
        for seed in range(6):
            order = list(rules.RULES)
            random.Random(seed).shuffle(order)
            verdicts.add(any(rules.RULES[n](text) for n in order))
        assert len(verdicts) == 1


def test_order_follows_rejections_per_cost(spark):
    def dear(t):
        sum(range(20_000))
        return len(t.words) % 2 == 0

    def cheap(t):
        return len(t.words) % 2 == 0

    rows = [(i, " ".join(f"w{i}x{k}" for k in range(20 + i % 9))) for i in range(90)]
    assert rules.cascade_order(table(spark, rows), {"dear": dear, "cheap": cheap, "never": lambda t: False}) == ["cheap", "dear", "never"]


def test_clean_text_stays_and_junk_goes(spark):
    rng = random.Random(4)
    clean = " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()) for _ in range(200)) + "."
    junk = " | ".join(rng.choice("one two three four five six seven".split()) for _ in range(60))
    shout = " ".join(f"LOUD{i}!!" for i in range(80))
    marks = " ".join(f"word{i}###" for i in range(80))
    kept = {r.doc_id: r.kept for r in rules.quality_rules(table(spark, [(1, clean), (2, junk), (3, shout), (4, marks)])).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False}


def test_empty_table(spark):
    assert rules.quality_rules(empty(spark)).collect() == []
    assert rules.quality_rules(documents(spark), rules={}).count() == len(texts())
