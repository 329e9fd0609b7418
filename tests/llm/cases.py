"""Small tables with every awkward case, and plain checks."""

import random

LONG = 2**63 - 1
WORDS = "the of and lorem ipsum dolor sit amet été über año naïve x1 42 --- | ### Zeta zeta".split()
CLASHES = "key_ hash n bucket label node start length content score shard slot kept rank size first row state n_lines"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
    f"{c} string" for c in CLASHES.split()
)


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def texts(seed=5):
    """(doc_id, text) with nulls, empty and long texts, copies, near copies, shared lines and repeated rows."""
    rng = random.Random(seed)
    shared = [sentence(rng, 30) for _ in range(3)]
    base = sentence(rng, 120)
    edited = base.split()
    edited[60] = "changed"
    rows = [(i, sentence(rng, rng.randint(1, 80))) for i in range(20)]
    rows += [(100 + i, sentence(rng, 12) + "\n" + shared[i % 3] + "\n  " + shared[0].upper() + "\t") for i in range(9)]
    rows += [(200, base), (201, base), (202, " ".join(edited)), (203, base + " " + sentence(rng, 6))]
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "\n\n"), (304, "word"), (305, "Word"), (306, "a b c d")]
    rows += [(None, base), (None, "lonely text " + sentence(rng, 40)), (None, None)]
    rows += [(400, "x" * 3000), (401, "ab" * 1500 + " end"), (402, sentence(rng, 4000))]
    rows += [(500, shared[1]), (500, shared[1]), (500, shared[2] + " more"), (-7, shared[1] + "\n" + shared[1])]
    rows += [(600, "tail  double  spaces "), (601, " lead"), (602, "nbsp  and　wide   line"), (603, "a<|endoftext|> b")]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, *["clash"] * len(CLASHES.split())) for i, t in rows], SCHEMA)


def documents(spark, seed=5):
    return table(spark, texts(seed)).repartition(3)


def empty(spark):
    return table(spark, [])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
