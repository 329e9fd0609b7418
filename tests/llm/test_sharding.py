import zlib

from noticemill.llm.sharding import shard_by_bytes

from .cases import LONG, documents, empty, table, texts


def brute(rows, n):
    items = sorted((LONG if i is None else i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows)
    total, start, out, slots = sum(x[2] for x in items), 0, [], {}
    for i, crc, size in items:
        shard = (2 * start + size) * n // (2 * total)
        slots[shard] = slots.get(shard, -1) + 1
        out.append((None if i == LONG else i, size, crc, shard, slots[shard]))
        start += size
    return sorted(out, key=repr)


def test_matches_brute_force(spark):
    for n in (1, 4, 16):
        found = [tuple(r) for r in shard_by_bytes(documents(spark), n).collect()]
        assert sorted(found, key=repr) == brute(texts(), n)


def test_shards_are_even_and_contiguous(spark):
    rows = [(i, "x" * (i * 7919 % 500)) for i in range(2000)]
    found = sorted(tuple(r) for r in shard_by_bytes(table(spark, rows).repartition(5), 16).collect())
    shards = [r[3] for r in found]
    assert shards == sorted(shards) and set(shards) == set(range(16))
    sizes = [sum(r[1] for r in found if r[3] == s) for s in range(16)]
    assert max(sizes) - min(sizes) <= 2 * 501


def test_equal_rows_and_empty_table(spark):
    assert shard_by_bytes(empty(spark)).collect() == []
    found = [tuple(r) for r in shard_by_bytes(table(spark, [(1, "same")] * 50), 4).collect()]
    assert sorted((r[3], r[4]) for r in found) == sorted((s, i) for s in range(4) for i in range([13, 12, 12, 13][s])) or len(
        {(r[3], r[4]) for r in found}
    ) == 50
