"""Phrase collocation mining: pairs of frequency-ranked ids counted in tiles, frequent pairs ranked again as ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .common import as_bytes, documents

NO_LANG = "und"
SIDE = 512  # ids in a side of a tile
HEAD = 16  # tiles in a side of the square that may be counted densely
BREAK = -1  # stands in a sequence where no phrase may reach across

# Bytes that end a piece, and bytes between words.
PIECE_ENDS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"


def _tables() -> tuple[bytes, np.ndarray]:
    lower = bytearray(range(256))
    lower[65:91] = lower[97:123]
    for b in PIECE_ENDS:
        lower[b] = 10
    between = np.zeros(256, bool)
    between[list(SPACES + b"\n")] = True
    return bytes(lower), between


FOLDED, BETWEEN = _tables()


def word_sequence(data: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(codes with breaks between pieces, distinct words, their counts) of folded text; the codes index the words."""
    chars = np.frombuffer(data, np.uint8)
    between = BETWEEN[chars]
    edge = np.flatnonzero(np.diff(between, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    ends = np.concatenate([[0], np.cumsum(end - start)])
    body = pa.py_buffer(chars[~between].tobytes())
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), body])
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    piece = np.cumsum(chars == 10)[start] if len(start) else np.zeros(0, np.int64)
    at = np.arange(len(code)) + np.cumsum(np.diff(piece, prepend=piece[:1]) > 0)
    seq = np.full(int(at[-1]) + 1 if len(at) else 0, BREAK, np.int32)
    seq[at] = code
    return seq, coded.dictionary, np.bincount(code, minlength=len(coded.dictionary))


def tile_counts(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, count) of the distinct pairs, and for each pair given its place among them.

    Ids are ranked by frequency, so the pairs crowd into the tiles of small ids.  A tile that holds enough of them is
    counted by direct address, one cell for each pair of its ids; the pairs of all other tiles are sorted as coordinates.
    """
    code = np.empty(len(left), np.int64)
    lefts, rights, counts, done = [], [], [], 0
    tile_l, tile_r = left // SIDE, right // SIDE
    tile = np.where((tile_l < HEAD) & (tile_r < HEAD), tile_l * HEAD + tile_r, HEAD * HEAD)
    held = np.bincount(tile, minlength=HEAD * HEAD + 1)[: HEAD * HEAD]
    dense = held >= SIDE * SIDE // 8
    for t in np.flatnonzero(dense).tolist():
        own = np.flatnonzero(tile == t)
        cell = (left[own] % SIDE) * SIDE + right[own] % SIDE
        found = np.bincount(cell, minlength=SIDE * SIDE)
        cells = np.flatnonzero(found)
        place = np.empty(SIDE * SIDE, np.int64)
        place[cells] = done + np.arange(len(cells))
        code[own] = place[cell]
        lefts.append(t // HEAD * SIDE + cells // SIDE)
        rights.append(t % HEAD * SIDE + cells % SIDE)
        counts.append(found[cells])
        done += len(cells)
    rest = np.flatnonzero(~np.append(dense, False)[tile])
    x, y = left[rest], right[rest]
    order = np.argsort(x * (y.max() + 1) + y) if len(x) and x.max() < 2**62 // (y.max() + 1) else np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    first = np.flatnonzero(new)
    code[rest[order]] = done + np.cumsum(new) - 1
    lefts.append(x[first])
    rights.append(y[first])
    counts.append(np.diff(np.append(first, len(x))))
    return np.concatenate(lefts), np.concatenate(rights), np.concatenate(counts), code


def neighbours(ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, code) of the neighbours that both have an id, and (left, right, count) of the distinct ones."""
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    left, right, count, code = tile_counts(ids[at].astype(np.int64), ids[at + 1].astype(np.int64))
    return at, code, left, right, count


def spaced(at: np.ndarray, ids: np.ndarray, kind: type) -> np.ndarray:
    """The ids that are not breaks as a sequence, with a break wherever their places do not follow each other."""
    held = ids >= 0
    at, ids = at[held], ids[held]
    gap = np.cumsum(np.diff(at, prepend=at[:1]) > 1)
    out = np.full(len(at) + int(gap[-1]) if len(at) else 0, BREAK, kind)
    out[np.arange(len(at)) + gap] = ids
    return out


def _kind(n_ids: int) -> type:
    return np.int32 if n_ids < 2**31 else np.int64


def _row(*values: np.ndarray | pa.Array) -> list[pa.Array]:
    """One row: the first value as raw bytes, the others as lists."""
    lists = [v if isinstance(v, pa.Array) else pa.array(v.astype(np.int64)) for v in values[1:]]
    return [pa.array([values[0].tobytes()], pa.binary()), *[pa.ListArray.from_arrays([0, len(v)], v) for v in lists]]


def _blocks(data: bytes, most: int) -> Iterator[bytes]:
    """A long folded text cut where pieces end anyway."""
    while len(data) > most and (at := data.find(b"\n", most)) >= 0:
        yield data[:at]
        data = data[at + 1 :]
    yield data


def _runs_of_words(docs: DataFrame, run_bytes: int, row: Callable, schema: str) -> DataFrame:
    """``row(lang, seq, words, counts)`` for runs of about ``run_bytes`` of texts of one language; None gives no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def coded(lang: str) -> Iterator[pa.RecordBatch]:
            del size[lang]
            if (out := row(lang, *word_sequence(b"\n".join(held.pop(lang))))) is not None:
                yield out

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                for block in _blocks(text.translate(FOLDED), run_bytes):
                    held.setdefault(lang, []).append(block)
                    size[lang] = size.get(lang, 0) + len(block)
                    if size[lang] >= run_bytes:
                        yield from coded(lang)
            while sum(size.values()) > 4 * run_bytes:  # many languages: the fullest goes first
                yield from coded(max(size, key=size.get))
        for lang in sorted(held):
            yield from coded(lang)

    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG))
    return docs.select(lang.alias("lang"), F.col("text").cast("string")).mapInArrow(run, schema)


def _word_row(with_seq: bool) -> Callable:
    def row(lang: str, seq: np.ndarray, words: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        columns = _row(seq, words.cast(pa.binary()).cast(pa.string()), counts)
        names = ["lang", *["seq"] * with_seq, "words", "counts"]
        return pa.RecordBatch.from_arrays([pa.array([lang]), *columns[1 - with_seq :]], names=names)

    return row


def word_tables(docs: DataFrame, run_bytes: int) -> DataFrame:
    """(lang, words, counts): the distinct words of each run."""
    return _runs_of_words(docs, run_bytes, _word_row(False), "lang string, words array<string>, counts array<long>")


def first_sequences(docs: DataFrame, frequent: DataFrame, n: int, run_bytes: int, broadcast_bytes: int) -> DataFrame:
    """(run, seq): the texts as ids of frequent words, with breaks for other words and between pieces."""
    kind = _kind(n)
    heavy = n * 16 > broadcast_bytes or frequent.agg(F.sum(F.octet_length("word") + 16)).first()[0] > broadcast_bytes
    if not heavy:
        known: dict[str, tuple[pa.Array, np.ndarray]] = {}
        rows = frequent.select("lang", "word", "id").toPandas()
        for lang, own in rows.groupby("lang"):
            words = pa.array([w.encode() for w in own["word"]], pa.large_binary())
            known[lang] = words, np.append(own["id"].to_numpy(np.int64), BREAK)

        def ids(lang: str, seq: np.ndarray, words: pa.Array, counts: np.ndarray) -> pa.RecordBatch | None:
            if lang not in known:
                return None
            found = pc.fill_null(pc.index_in(words, value_set=known[lang][0]), -1).to_numpy()
            rank = np.append(known[lang][1][found], BREAK)[seq]
            return pa.RecordBatch.from_arrays(_row(spaced(np.arange(len(rank)), rank, kind)), names=["seq"])

        return _numbered(_runs_of_words(docs, run_bytes, ids, "seq binary"))
    schema = "lang string, seq binary, words array<string>, counts array<long>"
    runs = _numbered(_runs_of_words(docs, run_bytes, _word_row(True), schema))
    return _with_ids(runs, _entries(runs, WORD, ["words"]), frequent, WORD, kind)


def _numbered(rows: DataFrame) -> DataFrame:
    return cut(rows.withColumn("run", F.monotonically_increasing_id()))


WORD = {"lang": "lang", "word": "entry.words"}
PAIR = {"left": "entry.lefts", "right": "entry.rights"}


def _entries(runs: DataFrame, key: dict[str, str], lists: list[str]) -> DataFrame:
    """The rows of the runs' tables: the key, its code in the run and its count there."""
    return runs.select("*", F.posexplode(F.arrays_zip(*lists, "counts")).alias("code", "entry")).select(
        *(["run"] if "run" in runs.columns else []),
        "code",
        *[F.col(c).alias(name) for name, c in key.items()],
        F.col("entry.counts").alias("count"),
    )


def _with_ids(runs: DataFrame, entries: DataFrame, frequent: DataFrame, key: dict[str, str], kind: type) -> DataFrame:
    """(run, seq): each run asks for the ids of its own keys by a join that carries a key once a run."""

    def relabel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seq, rows in zip(batch.column(0), batch.column(1), strict=True):
                code, rank = (rows.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                local = np.frombuffer(seq.as_buffer(), np.int32)
                known = np.full(int(max(local.max(initial=0), code.max())) + 2, BREAK, np.int64)  # the last place: breaks
                known[code] = rank
                out = spaced(np.arange(len(local)), known[local], kind)
                yield pa.RecordBatch.from_arrays(_row(out), names=["seq"])

    known = entries.join(frequent.select("id", *key), list(key)).groupBy("run").agg(F.collect_list(F.struct("code", "id")).alias("known"))
    return _numbered(runs.select("run", "seq").join(known, "run").select("seq", "known").mapInArrow(relabel, "seq binary"))


def pair_tables(sequences: DataFrame, kind: type, with_seq: bool = False) -> DataFrame:
    """(lefts, rights, counts): the distinct neighbours of each sequence; with ``seq`` of their codes if asked for."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*["seq"] * with_seq, "lefts", "rights", "counts"]
        for batch in batches:
            for seq in batch.column(0):
                at, code, *found = neighbours(np.frombuffer(seq.as_buffer(), kind))
                if len(at):
                    yield pa.RecordBatch.from_arrays(_row(spaced(at, code, np.int32), *found)[1 - with_seq :], names=names)

    schema = "lefts array<long>, rights array<long>, counts array<long>"
    return sequences.select("seq").mapInArrow(pairs, "seq binary, " * with_seq + schema)


def next_sequences(sequences: DataFrame, frequent: DataFrame, kind: type, n: int, broadcast_bytes: int) -> DataFrame:
    """(run, seq): the sequences as ids of frequent pairs, with breaks for all others."""
    after = _kind(n)
    if n * 24 > broadcast_bytes:
        runs = _numbered(pair_tables(sequences, kind, with_seq=True))
        return _with_ids(runs, _entries(runs, PAIR, ["lefts", "rights"]), frequent, PAIR, after)
    rows = frequent.select("left", "right", "id").toPandas().sort_values(["left", "right"])
    base = int(rows["right"].max()) + 1
    keys, ids = rows["left"].to_numpy(object) * base + rows["right"].to_numpy(object), rows["id"].to_numpy(np.int64)
    exact = keys.astype(np.int64) if keys[-1] < 2**63 else None
    if exact is None:  # ids beyond 32 bits: as tuples
        by_pair = dict(zip(zip(rows["left"], rows["right"]), rows["id"]))

    def place(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if exact is None:
            return np.array([by_pair.get(p, BREAK) for p in zip(left.tolist(), right.tolist())], np.int64)
        key = np.where((right < base) & (left <= (2**63 - 1 - right) // base), left * base + right, -1)
        at = np.minimum(np.searchsorted(exact, key), len(exact) - 1)
        return np.where(exact[at] == key, ids[at], BREAK)

    def relabel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seq in batch.column(0):
                at, code, left, right, _ = neighbours(np.frombuffer(seq.as_buffer(), kind))
                out = spaced(at, place(left, right)[code], after)
                if len(out) > 1:  # a lone id has no neighbour
                    yield pa.RecordBatch.from_arrays(_row(out), names=["seq"])

    return _numbered(sequences.select("seq").mapInArrow(relabel, "seq binary"))


def ranked(counted: DataFrame, key: list[str]) -> DataFrame:
    """``counted`` with an ``id`` from 0 by falling ``f``: sorted by ranges, numbered from the ranges' sizes."""
    low = F.lit(2**33 - 1)  # Spark's id of a row: its partition above 33 bits of its place there
    rows = cut(counted.orderBy(F.desc("f"), *key).withColumn("row", F.monotonically_increasing_id()))
    sizes = rows.groupBy(F.shiftright("row", 33).alias("part")).agg(F.count("*").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))  # a row for a partition
    placed = rows.withColumn("part", F.shiftright("row", 33)).join(F.broadcast(starts), "part")
    return placed.withColumn("id", F.col("start") + F.col("row").bitwiseAND(low)).drop("row", "part", "start")


def _frequent(entries: DataFrame, key: dict[str, str], least: int) -> DataFrame:
    counted = entries.groupBy(*key).agg(F.sum("count").alias("f")).filter(F.col("f") >= least)
    return cut(ranked(counted, list(key)))


def collocations(
    docs: DataFrame,
    least: int = 100,
    max_words: int = 5,
    top: int = 2000,
    covered_percent: int = 100,
    run_bytes: int = 8 << 20,
    broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by their weakest cut.

    Texts are A-Z lower-cased and cut into pieces at sentence marks and line ends, pieces into words at spaces and tabs.
    Per language (null: ``und``) n counts all words and f all contiguous occurrences of a phrase inside pieces.
    Candidates are phrases of 2 to ``max_words`` words with a = f >= ``least``.  A cut after k words scores
    floor(1000 * a * n / (l * r)) from the counts of both parts; the lowest cut counts, ties to the smallest k.
    A candidate that lies in a longer candidate with at least ``covered_percent`` in 100 of its count is dropped.
    Rows are ordered by score and a, falling, then by the phrase's bytes.

    Null texts are empty; doc_id and other columns are ignored, so repeated rows all count; an empty table gives no rows.

    Runs of texts give tables of their own words, so a word travels once a run; words that occur ``least`` times get
    ids by falling frequency, and the texts become sequences of ids.  Neighbouring ids are counted in tiles, frequent
    pairs get ids in turn, and neighbouring pairs are phrases of three words, and so on.  A phrase can only be frequent
    if both its shorter ends are, so nothing is lost.  The ids of a level go to all tasks while they take no more than
    ``broadcast_bytes``; larger levels are met by a join in which each run asks for its own words or pairs.  A phrase's
    counts of beginnings and ends are carried along the same steps.  A longer candidate that covers a phrase is no more
    frequent than one that is longer by a word, so only those are compared.
    """
    held = _entries(word_tables(docs, run_bytes), WORD, ["words"])
    totals = held.groupBy("lang").agg(F.sum("count").alias("n"))  # a row for a language
    frequent = _frequent(held, WORD, least)
    own = F.array("f")
    phrases = frequent.select("id", "lang", F.array("word").alias("words"), own.alias("begins"), own.alias("ends"))
    levels: list[DataFrame] = []
    sequences, n = None, frequent.count()
    while n and len(levels) < max_words - 1:
        if sequences is None:
            sequences = first_sequences(docs, frequent, n, run_bytes, broadcast_bytes)
        else:
            sequences = next_sequences(sequences, frequent, kind, n, broadcast_bytes)
        kind = _kind(n)
        frequent = _frequent(_entries(pair_tables(sequences, kind), PAIR, ["lefts", "rights"]), PAIR, least)
        n = frequent.count()
        first = phrases.select(F.col("id").alias("left"), "lang", "words", "begins")
        last = phrases.select(F.col("id").alias("right"), F.element_at("words", -1).alias("word"), "ends")
        phrases = cut(
            frequent.join(first, "left")
            .join(last, "right")
            .select(
                "id",
                "lang",
                F.concat("words", F.array("word")).alias("words"),
                F.concat("begins", own).alias("begins"),
                F.concat(own, "ends").alias("ends"),
                "f",
                "left",
                "right",
            )
        )
        levels.append(phrases)
    if not levels:  # no word is frequent
        nothing = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
        return docs.sparkSession.createDataFrame([], nothing)
    scored = None
    for at, level in enumerate(levels):
        kept = level
        if at + 1 < len(levels):
            longer = levels[at + 1]
            cover = (
                longer.select(F.col("left").alias("id"), "f")
                .union(longer.select(F.col("right").alias("id"), "f"))
                .groupBy("id")
                .agg(F.max("f").alias("cover"))
            )
            open_ = F.col("cover").isNull() | (100 * F.col("cover") < covered_percent * F.col("f"))
            kept = level.join(cover, "id", "left").filter(open_)
        kept = kept.select("lang", "words", "begins", "ends", "f")
        scored = kept if scored is None else scored.union(kept)
    whole = "DECIMAL(38, 0)"  # exact products
    cuts = F.expr(
        f"""transform(sequence(1, size(words) - 1), k -> struct(
            (CAST(1000 AS {whole}) * f * n) div (CAST(begins[k - 1] AS {whole}) * ends[k]) AS score,
            k, begins[k - 1] AS l, ends[k] AS r))"""
    )
    best = scored.join(totals, "lang").select(
        "lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "n", F.array_min(cuts).alias("cut")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(documents(spark, folder))


ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
  FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)
), tot AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY lang
), g AS (
  SELECT lang, ws[i:i + m - 1] AS ph, m, count(*) AS f
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM p, range(1, 6) r(m)) GROUP BY ALL
), c AS (
  SELECT * FROM g WHERE m >= 2 AND f >= 100
), x AS (
  SELECT lang, ph[1:m - 1] AS ph, f FROM c UNION ALL SELECT lang, ph[2:m], f FROM c
  UNION ALL SELECT lang, ph[1:m - 2], f FROM c WHERE m >= 4 UNION ALL SELECT lang, ph[2:m - 1], f FROM c WHERE m >= 4
  UNION ALL SELECT lang, ph[3:m], f FROM c WHERE m >= 4
  UNION ALL SELECT lang, ph[i:i + 1], f FROM c, range(1, 5) r(i) WHERE m = 5
), kept AS (
  SELECT c.* FROM c WHERE NOT EXISTS (
    SELECT 1 FROM x WHERE x.lang = c.lang AND x.ph = c.ph AND 100 * x.f >= 100 * c.f)
), k AS (
  SELECT kept.lang, kept.ph, kept.f AS a, i, u.f AS l, v.f AS r, tot.n,
         ((1000::HUGEINT * kept.f * tot.n) // (u.f::HUGEINT * v.f))::BIGINT AS score
  FROM kept, range(1, 5) q(i), g u, g v, tot
  WHERE i < kept.m AND u.lang = kept.lang AND v.lang = kept.lang AND u.ph = kept.ph[1:i]
    AND v.ph = kept.ph[i + 1:kept.m] AND tot.lang = kept.lang
), b AS (
  SELECT *, row_number() OVER (PARTITION BY lang, ph ORDER BY score, i) AS nth FROM k
), o AS (
  SELECT lang, array_to_string(ph, ' ') AS phrase, a, l, r, n, score FROM b WHERE nth = 1
)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
         phrase, a, l, r, n, score FROM o
) WHERE rank <= 2000
"""
