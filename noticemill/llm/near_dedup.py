"""MinHash near-dedup: min-max hashing, banded candidates, links confirmed on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .common import WordHashes, as_bytes, documents, id_key, mix, original_id, runs
from .components import Groups, components, settled

WORDS = 5
ODD = np.uint64(0x9E3779B97F4A7C15)
VALUES = 180  # signature values: a minimum and a maximum for half as many permutations
BLOCK = 256  # members of a bucket or cluster in a block; tasks compare pairs of blocks
BLOCK_SHINGLES = 2_000_000  # shingles of a cluster in a block


def shingle_sets(texts: list[bytes], hashes: WordHashes) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's 5-word shingles; fewer words are one shingle; no words: empty."""
    for lo, hi in runs(texts, 1 << 20):
        h, sizes = hashes(texts[lo:hi])
        windows = max(0, len(h) - WORDS + 1)
        s = h[:windows]
        for i in range(1, WORDS):
            s = mix(s * ODD + h[i : windows + i])
        for end, n in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
            if n >= WORDS:
                yield np.unique(s[end - n : end - WORDS + 1])
            else:
                whole = np.full(1, n, np.uint64)
                for word in h[end - n : end]:
                    whole = mix(whole * ODD + word)
                yield whole[: min(n, 1)]


class MinMax:
    """Signatures of shingle sets: each permutation is evaluated once and gives its minimum and its maximum.

    Bands take minima or maxima of different permutations, never both of one, so the values in a band are independent.
    Rows and bands are the ones with the longest bands whose chance to miss a pair at the threshold is below 1e-6.
    """

    def __init__(self, threshold: float, seed: int = 11):
        self.rows = max(
            (r for r in range(1, 16) if (1 - threshold**r) ** (VALUES // (2 * r) * 2) < 1e-6), default=1
        )
        self.half = VALUES // (2 * self.rows)  # bands of minima; as many of maxima
        self.factors = np.random.default_rng(seed).integers(0, 2**63, VALUES // 2, np.uint64) * np.uint64(2) + np.uint64(1)
        # a pair at the threshold agrees in fewer places with a chance below 1e-9
        p = threshold + (1 - threshold) / 256
        self.agreeing = math.floor(VALUES * p - 6.5 * math.sqrt(VALUES * p * (1 - p)))

    def __call__(self, s: np.ndarray) -> tuple[list[int], bytes]:
        """Band keys and a sketch of one byte per value."""
        low = np.full(len(self.factors), 2**64 - 1, np.uint64)
        high = np.zeros(len(self.factors), np.uint64)
        for at in range(0, len(s), 512):
            h = s[at : at + 512, None] * self.factors
            np.minimum(low, h.min(axis=0), out=low)
            np.maximum(high, h.max(axis=0), out=high)
        used = self.half * self.rows
        bands = np.concatenate([low[:used], high[:used]]).reshape(2 * self.half, self.rows)
        key = np.arange(len(bands), dtype=np.uint64)
        for i in range(self.rows):
            key = mix(key * ODD + bands[:, i])
        sketch = np.concatenate([low, high]).astype(np.uint8).tobytes()
        return key.view(np.int64).tolist(), sketch


def _marked(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(id_key().alias("key_"), text.alias("text"), F.xxhash64(text).alias("mark"))


def signatures(docs: DataFrame, method: MinMax) -> DataFrame:
    """(key_, mark, n_shingles, content, bands, sketch); content is a 128-bit hash of the set, null without words.

    ``mark`` is a hash of the text, so that rows that share an id are told apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, contents, bands, sketches = [], [], [], []
            for s in shingle_sets(as_bytes(batch.column(1)), hashes):
                sizes.append(len(s))
                contents.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                band, sketch = method(s) if len(s) else (None, None)
                bands.append(band)
                sketches.append(sketch)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(sizes, pa.int64()),
                    pa.array(contents, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(sketches, pa.binary()),
                ],
                names=["key_", "mark", "n_shingles", "content", "bands", "sketch"],
            )

    return _marked(docs).mapInArrow(
        run, "key_ long, mark long, n_shingles long, content binary, bands array<long>, sketch binary"
    )


def _bytes_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _agreement(pairs: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    """(a, b, agree) of the pairs whose sketches agree in ``least`` places or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            agree = (_bytes_matrix(batch.column(2)) == _bytes_matrix(batch.column(3))).sum(axis=1)
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(agree.astype(np.int32))], names=["a", "b", "agree"]
            )
            yield out.filter(pa.array(agree >= least))

    left = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("left"))
    right = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("right"))
    both = pairs.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "left", "right")
    return both.mapInArrow(run, "a long, b long, agree int")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose full sets share ``percent`` in 100 of their union or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                shared = int((large[at] == small).sum())
                linked.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    both = pairs.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "left", "right")
    return both.mapInArrow(run, "a long, b long")


def _shingles(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted (node, key_, mark, content): their full sets as 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            nodes, sets = [], []
            sets_ = shingle_sets(as_bytes(batch.column(1)), hashes)
            for node, found, content in zip(batch.column(0).to_pylist(), sets_, batch.column(2).to_pylist(), strict=True):
                s = found.tobytes()
                if xxhash.xxh3_128_digest(s) == content:  # a doc_id and a mark may stand for several texts
                    nodes.append(node)
                    sets.append(s)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"]
            )

    found = _marked(docs).join(wanted, ["key_", "mark"]).select("node", "text", "content").mapInArrow(run, "node long, shingles binary")
    return found.groupBy("node").agg(F.first("shingles").alias("shingles"))


def _best(likely: DataFrame, of: str) -> DataFrame:
    """The most alike pair of each value of ``of``, as (a, b) with the smaller first."""
    return (
        likely.groupBy(of)
        .agg(F.max(F.struct("agree", "a", "b")).alias("best"))
        .select(F.least("best.a", "best.b").alias("a"), F.greatest("best.a", "best.b").alias("b"))
        .distinct()
    )


def _blocks(n: Column) -> Column:
    return F.ceil(n / BLOCK).cast("int")


def _in_block_pairs(rows: DataFrame, blocks: Column) -> DataFrame:
    """Rows (with ``node``) dealt to every pair of blocks i <= j that holds them; ``own`` is a row's block."""
    return (
        rows.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        .drop("other")
    )


def _mixed(held: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, node, label, n) of the (node, bucket) rows whose bucket holds several labels; n: the bucket's rows."""
    rows = settled(held.join(labels.hint("merge"), "node", "left").select("node", "bucket", F.coalesce("label", "node").alias("label")))
    mixed = (
        rows.groupBy("bucket")
        .agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"))
        .filter("lo <> hi")
        .select("bucket", "n")
    )
    return rows.join(mixed.hint("merge"), "bucket").select("bucket", "node", "label", "n")


def _lone(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, lone): shingles of each of the ``nodes`` that no other of them has, where there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            for at in range(0, len(node), 256):
                sets_ = [np.frombuffer(s, np.int64) for s in batch.column(1).slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(node[at : at + 256], [len(s) for s in sets_])), pa.array(np.concatenate(sets_))],
                    names=["node", "shingle"],
                )

    held = sets.join(nodes.hint("merge"), "node").select("node", "shingles").mapInArrow(run, "node long, shingle long")
    once = held.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("other")).filter("node = other")
    return once.groupBy("node").agg(F.count("*").alias("lone"))


def _linkable(met: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, bucket, hub): the rows of ``met`` that may be linked with a member of their bucket.

    Of a set of n shingles, c stand in other sets of mixed buckets as well, so at most c are shared with a member.  That
    member has at least s, the bucket's smallest size: the union is not below n + s - c, nor below n.  A row for which c
    is too little drops out; no link is lost.  ``hub`` is the bucket's member with the smallest share of lone shingles.
    """
    nodes = cut(met.select("node").distinct())
    common = (
        sizes.join(nodes.hint("merge"), "node")
        .join(_lone(nodes, sets).hint("merge"), "node", "left")
        .select("node", "size", (F.col("size") - F.coalesce("lone", F.lit(0))).alias("common"))
    )
    rows = settled(met.select("node", "bucket").join(common.hint("merge"), "node"))
    buckets = rows.groupBy("bucket").agg(
        F.min("size").alias("least"),
        F.min(F.struct((F.lit(1) - F.col("common") / F.col("size")).alias("share"), "node"))["node"].alias("hub"),
    )
    enough = F.expr(f"100 * common >= {percent} * (size + greatest(least - common, 0))")
    return rows.join(buckets.hint("merge"), "bucket").filter(enough).select("node", "bucket", "hub")


def _bridges(held: DataFrame, labels: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    """(a, b): labels of different components that meet in a bucket with sketches agreeing in ``least`` places.

    A task gives no more rows than it has labels: enough pairs to connect all that are joined by such members.
    Buckets of one component drop out beforehand; a large bucket is dealt out as pairs of blocks.
    """
    dealt = _in_block_pairs(_mixed(held, labels).join(sketches.hint("merge"), "node"), _blocks(F.col("n"))).select(
        "bucket", "i", "j", "label", "sketch"
    )

    def meet(table: pa.Table) -> pa.Table:
        label = table.column("label").to_numpy()
        sketch = _bytes_matrix(table.column("sketch").combine_chunks())
        groups, a, b = Groups(), [], []
        open_ = len(np.unique(label)) - 1
        for x in range(len(label)):
            if not open_:
                break
            near = np.unique(label[(sketch == sketch[x]).sum(axis=1) >= least])
            for y in near.tolist():
                if groups.join(int(label[x]), y):
                    a.append(min(int(label[x]), y))
                    b.append(max(int(label[x]), y))
                    open_ -= 1
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("bucket", "i", "j").applyInArrow(meet, "a long, b long").distinct()


def _links_inside(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links on full sets between different labels of a cluster.

    ``open_`` has (node, label, cluster, size).  All members of a cluster are compared, in pairs of blocks of bounded
    rows and bytes, by counting shared shingles as products of incidence matrices.  A task gives no more rows than it
    has labels.
    """
    sizes = open_.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    blocks = F.greatest(_blocks(F.col("n")), F.ceil(F.col("shingles") / BLOCK_SHINGLES).cast("int"))
    rows = open_.join(sizes.hint("merge"), "cluster").withColumn("blocks", blocks).drop("n", "shingles", "size")
    dealt = _in_block_pairs(rows.join(sets.hint("merge"), "node"), F.col("blocks")).select(
        "cluster", "i", "j", "own", "node", "label", "shingles"
    )

    def link(table: pa.Table) -> pa.Table:
        node, label, own = (table.column(c).to_numpy() for c in ("node", "label", "own"))
        a, b = [], []
        if len(np.unique(label)) > 1:
            sets_ = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
            size = np.fromiter(map(len, sets_), np.int64, len(sets_))
            row = np.repeat(np.arange(len(sets_)), size)
            _, column, many = np.unique(np.concatenate(sets_), return_inverse=True, return_counts=True)
            number = np.where(many > 1, np.cumsum(many > 1) - 1, -1)[column]
            row, number = row[number >= 0], number[number >= 0]
            order = np.argsort(number, kind="stable")
            row, number = row[order], number[order]
            shared = np.zeros((len(sets_), len(sets_)), np.float32)
            last = int(number[-1]) + 1 if len(number) else 0
            for lo in range(0, last, 8192):
                these = slice(*np.searchsorted(number, [lo, lo + 8192]))
                part = np.zeros((len(sets_), 8192), np.float32)
                part[row[these], number[these] - lo] = 1
                shared += part @ part.T
            union = size[:, None] + size[None, :] - shared
            linked = (100 * shared >= percent * union) & (label[:, None] != label[None, :])
            if table.column("i")[0] != table.column("j")[0]:
                linked &= own[:, None] != own[None, :]
            groups = Groups()
            for x, y in np.argwhere(np.triu(linked)).tolist():
                if groups.join(int(label[x]), int(label[y])):
                    a.append(min(int(node[x]), int(node[y])))
                    b.append(max(int(node[x]), int(node[y])))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("cluster", "i", "j").applyInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row.

    A text's words are its A-Z lower-cased runs without ASCII white space, its set the distinct 5-word shingles (fewer
    words: the whole as one).  Rows are linked when their sets share ``percent`` in 100 of their union or more;
    component_id is the smallest doc_id reachable over links and ``kept`` marks the rows that hold it.  Null, empty and
    wordless texts are linked with nothing and keep their own id.  Rows that repeat a doc_id are judged by their own
    texts; null ids count as one id after all others and come out null.  Other columns are ignored, and an empty table
    gives no rows.

    Equal sets are settled by one grouping, so copies take no further part.  Banded min-max signatures propose pairs;
    at the threshold a pair shares no band with a chance below 1e-6.  First each set meets the more alike of its
    buckets' ends, confirmed on full sets.  In buckets that still hold several components, sets with too many shingles
    of their own to be linked with any member drop out, and the others meet the member with the fewest such shingles.
    Components that meet even then in a bucket with sketches that may reach the threshold are gathered into clusters,
    and all members of a cluster are compared on full sets, so every pair that shares a band is settled.  No bucket is capped; large buckets and clusters are dealt out as pairs of blocks;
    no task gives more rows than its members need to be connected.
    """
    method = MinMax(percent / 100)
    sigs = cut(signatures(docs, method))
    classes = cut(
        sigs.filter("content IS NOT NULL")
        .groupBy("content")
        .agg(
            F.min(F.struct("key_", "mark")).alias("row"),
            F.first("n_shingles").alias("size"),
            F.first("bands").alias("bands"),
            F.first("sketch").alias("sketch"),
        )
        .select("content", "row.key_", "row.mark", "size", "bands", "sketch")
        .withColumn("node", F.monotonically_increasing_id())
    )
    sketches = classes.select("node", "sketch")
    spread = classes.select("node", F.explode("bands").alias("bucket"))
    ends = spread.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi")
    held = settled(spread.join(ends.hint("merge"), "bucket"))
    first = (
        held.select("node", F.explode(F.array("lo", "hi")).alias("end"))
        .filter("node <> end")
        .select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b"))
        .distinct()
    )
    likely = settled(_agreement(first, sketches, method.agreeing))
    both = likely.withColumn("node", F.explode(F.array("a", "b")))
    best = _best(both, "node")
    held = held.select("node", "bucket")
    sets = cut(_shingles(docs, classes.join(held.select("node").distinct(), "node").select("node", "key_", "mark", "content")))
    links = settled(_confirmed(best, sets, percent))
    labels = components(links)
    near = settled(_linkable(settled(_mixed(held, labels)), classes.select("node", "size"), sets, percent))
    hubs = (
        near.filter("node <> hub")
        .select("node", F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
        .distinct()
    )
    likely = _agreement(hubs.select("a", "b").distinct(), sketches, method.agreeing)
    best = _best(settled(likely.join(hubs.hint("merge"), ["a", "b"])), "node")
    links = settled(links.union(_confirmed(best, sets, percent)))
    labels = components(links)
    bridges = components(_bridges(near.select("node", "bucket"), labels, sketches, method.agreeing))
    open_ = settled(
        classes.select("node", "size")
        .join(labels.hint("merge"), "node", "left")
        .withColumn("label", F.coalesce("label", "node"))
        .join(bridges.select(F.col("node").alias("label"), F.col("label").alias("cluster")), "label")
    )
    labels = components(links.union(_links_inside(open_, sets, percent)))
    named = settled(
        classes.select("node", "content", "key_")
        .join(labels.hint("merge"), "node", "left")
        .select("content", "key_", F.coalesce("label", "node").alias("label"))
    )
    least = named.groupBy("label").agg(F.min("key_").alias("component"))
    placed = named.join(least.hint("merge"), "label").select("content", "component")
    return (
        sigs.select("key_", "n_shingles", "content")
        .join(placed.hint("merge"), "content", "left")
        .withColumn("component", F.coalesce("component", "key_"))
        .select(
            original_id("key_").alias("doc_id"),
            "n_shingles",
            original_id("component").alias("component_id"),
            (F.col("key_") == F.col("component")).alias("kept"),
        )
    )


def op8_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder), percent=85)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id
  GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * k >= 85 * (u.n + v.n - k)
), r(node, reached) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached
), m AS (
  SELECT node AS doc_id, min(reached) AS component_id FROM r GROUP BY node
)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept
FROM m LEFT JOIN n ON n.doc_id = m.doc_id
"""
