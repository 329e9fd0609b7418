"""Language ID by partial matching: per-language trees of byte contexts give the code length of a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, documents, runs

UNKNOWN = "und"
ORDER = 5  # bytes of the longest context; with the symbol they must fit into 7 bytes
BLOCK = 1 << 19  # positions scored at a time
FOLD_CASE = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fold() -> Column:
    """0 for ids that training never sees; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5


def windows(texts: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, window, bytes before) of all positions, in blocks.

    A window holds a byte and the ``order`` bytes before it, the byte itself lowest.  A line feed stands before each
    text; windows that would reach beyond it are told by the number of bytes before.
    """
    data = np.frombuffer(b"".join(b"\n" + t.translate(FOLD_CASE) for t in texts), np.uint8)
    starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
    for lo in range(0, len(data), BLOCK):
        at = np.arange(lo, min(lo + BLOCK, len(data)))
        reach = max(0, lo - order)
        part = data[reach : at[-1] + 1].astype(np.uint64)
        window = part.copy()
        for i in range(1, min(order, len(part) - 1) + 1):
            window[i:] |= part[:-i] << np.uint64(8 * i)
        text = np.searchsorted(starts, at, side="right") - 1
        before = at - starts[text]
        real = before > 0
        yield text[real], window[lo - reach :][real], before[real]


def _low(window: np.ndarray, n_bytes: int) -> np.ndarray:
    return window & np.uint64((1 << (8 * n_bytes)) - 1)


def _place(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted values stand in the sorted keys, and whether they do."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


@dataclass
class ContextTrees:
    """Code lengths in bits of the windows of each order, a column for each language, and what an escape costs.

    ``seen[k]`` are the windows with k context bytes that some language has seen, ``bits[k]`` their code lengths.
    ``contexts[k]`` are the contexts of those windows, ``escapes[k]`` the bits of leaving them for the next shorter one.
    """

    langs: list[str]
    seen: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        top = len(self.seen) - 1
        out = np.zeros((len(texts), len(self.langs)))
        for text, window, before in windows(texts, top):
            open_ = np.arange(len(text))
            cost = np.zeros((len(text), len(self.langs)), np.float32)
            for k in range(top, -1, -1):
                deep = before[open_] >= k
                here = open_[deep]
                value = _low(window[here], k + 1)
                at, hit = _place(self.seen[k], value)
                cost[here[hit]] += self.bits[k][at[hit]]
                missed = here[~hit]
                at, known = _place(self.contexts[k], value[~hit] >> np.uint64(8))
                cost[missed[known]] += self.escapes[k][at[known]]
                open_ = np.sort(np.concatenate([open_[~deep], missed]))
            first = np.flatnonzero(np.diff(text, prepend=-1))
            if len(first):
                out[text[first]] += np.add.reduceat(cost, first, axis=0, dtype=np.float64)
        return out


def _one_language(keys: np.ndarray, counts: np.ndarray, shorter: tuple | None) -> tuple[np.ndarray, ...]:
    """(windows, chances, contexts, escape factors) of one order from the counts of its windows and the order below.

    A context seen T times with D different symbols gives a symbol count / (T + D) and leaves D / (T + D) to the symbols
    it has not seen, in the proportions of the next shorter context; so the chances of all 256 symbols sum to one.
    """
    context = keys >> np.uint64(8)
    first = np.flatnonzero(np.diff(context, prepend=~context[:1]))
    total = np.add.reduceat(counts, first)
    kinds = np.diff(np.append(first, len(keys)))
    part = np.repeat(np.arange(len(first)), kinds)
    chance = counts / (total + kinds)[part]
    if shorter is None:
        left = np.full(len(first), 256.0) - kinds  # each unseen symbol alike
    else:
        below, n_bytes = shorter
        left = 1 - np.add.reduceat(below[1][np.searchsorted(below[0], _low(keys, n_bytes))], first)
    return keys, chance, context[first], kinds / (total + kinds) / np.maximum(left, 1e-12)


def build_trees(langs: list[str], counted: list[list[tuple[np.ndarray, np.ndarray]]]) -> ContextTrees:
    """Trees from ``counted[language][order]``: sorted windows and their counts, shorter windows of each included."""
    trees = ContextTrees(langs, [], [], [], [])
    below: list[tuple | None] = [None] * len(langs)
    for k in range(len(counted[0])):
        own = []
        for i, orders in enumerate(counted):
            keys, counts = orders[k]
            own.append(_one_language(keys, counts, below[i] and (below[i], k)) if len(keys) else None)
        if k == 0:
            seen = np.arange(256, dtype=np.uint64)
            bits = np.full((256, len(langs)), 8.0, np.float32)
            contexts, escapes = np.zeros(0, np.uint64), np.zeros((0, len(langs)), np.float32)
        else:
            seen = np.unique(np.concatenate([o[0] for o in own if o] or [np.zeros(0, np.uint64)]))
            contexts = np.unique(seen >> np.uint64(8))
            escapes = np.zeros((len(contexts), len(langs)), np.float32)
            bits = trees.bits[-1][np.searchsorted(trees.seen[-1], _low(seen, k))].copy()
        for i, o in enumerate(own):
            if not o:
                continue
            if k == 0:
                bits[:, i] = -np.log2(o[3][0])
            else:
                escapes[np.searchsorted(contexts, o[2]), i] = -np.log2(o[3])
                bits[:, i] += escapes[np.searchsorted(contexts, seen >> np.uint64(8)), i]
            bits[np.searchsorted(seen, o[0]), i] = -np.log2(o[1])
        trees.seen.append(seen)
        trees.bits.append(bits)
        trees.contexts.append(contexts)
        trees.escapes.append(escapes)
        below = own
    return trees


def fit_languages(docs: DataFrame, fit_bytes: int = 1 << 19, order: int = ORDER, least: int = 2) -> ContextTrees:
    """Trees learned from text and lang of the documents whose crc32(doc_id as text) mod 5 is not 0.

    Of each language about ``fit_bytes`` of text are counted: the documents whose hashed id falls below the share that
    this is of its bytes (all of them where there is less).  Documents without lang, text or id teach nothing.
    Windows with context bytes count from ``least`` occurrences; the counts of a sample come to the driver.
    """
    known = docs.select(
        "doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    ).filter(F.col("lang").isNotNull() & (F.octet_length("text") > 0) & (fold() != 0))
    sizes = known.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes")).collect()  # a row for a language
    if not sizes:
        return ContextTrees([], [], [], [], [])
    share = F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], fit_bytes / r["bytes"])])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    sample = known.filter(draw < F.try_element_at(share, F.col("lang")))
    sample = sample.select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist(), object)
            texts = as_bytes(batch.column(1))
            for lo, hi in runs(texts):
                for name in sorted(set(lang[lo:hi])):
                    own = [texts[i] for i in range(lo, hi) if lang[i] == name]
                    for _, window, before in windows(own, order):
                        for k in range(order + 1):
                            keys, n = np.unique(_low(window[before >= k], k + 1), return_counts=True)
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array([name] * len(keys)),
                                    pa.array(np.full(len(keys), k, np.int32)),
                                    pa.array(keys.astype(np.int64)),
                                    pa.array(n.astype(np.int64)),
                                ],
                                names=["lang", "k", "window", "n"],
                            )

    rows = (
        sample.mapInArrow(count, "lang string, k int, window long, n long")
        .groupBy("lang", "k", "window")
        .agg(F.sum("n").alias("n"))
        .filter((F.col("k") == 0) | (F.col("n") >= least))
        .toArrow()
    )
    names = rows.column("lang").combine_chunks().dictionary_encode()
    lang = names.indices.to_numpy()
    k, window, n = (rows.column(c).to_numpy() for c in ("k", "window", "n"))
    langs = sorted(names.dictionary.to_pylist())
    counted = []
    for name in langs:
        own = np.flatnonzero(lang == names.dictionary.index(name).as_py())
        own = own[np.lexsort((window[own], k[own]))]
        parts = [own[k[own] == j] for j in range(order + 1)]
        counted.append([(window[p].astype(np.uint64), n[p].astype(np.float64)) for p in parts])
    return build_trees(langs, counted)


def languages(docs: DataFrame, fit_bytes: int = 1 << 19, order: int = ORDER, least: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): the language under whose tree a text is shortest, one row per input row.

    See ``fit_languages`` for what is learned from.  A text's length is the sum of the code lengths of its bytes (A-Z
    lower-cased), each under the longest known context and the escapes down from it, all with frozen counts.  The score
    is the chance of the language among those learned, all equally likely beforehand.  Ties go to the language that
    comes first.  Texts that are null or hold no letter, and all texts if no language was learned, are ``und`` with
    score 0.  Repeated rows each get a row; null ids are held out; other columns are ignored; an empty table gives no
    rows.  Every text is read whole, in one pass without a shuffle; the trees are of bounded size and travel with tasks.
    """
    trees = fit_languages(docs, fit_bytes, order, least)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, letters = as_bytes(batch.column(1)), batch.column(2).to_pylist()
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            judged = [i for i, yes in enumerate(letters) if yes and trees.langs]
            for lo, hi in runs([texts[i] for i in judged], 1 << 20):
                bits = trees.lengths([texts[i] for i in judged[lo:hi]])
                best = bits.argmin(axis=1)
                scores[judged[lo:hi]] = 1 / np.exp2(bits.min(axis=1, keepdims=True) - bits).sum(axis=1)
                for i, b in zip(judged[lo:hi], best.tolist(), strict=True):
                    langs[i] = trees.langs[b]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"]
            )

    text = F.col("text").cast("string")
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return (
        docs.select(F.col("doc_id").cast("long"), text.alias("text"), letters.alias("letters"))
        .mapInArrow(predict, "doc_id long, lang_pred string, score double")
        .select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")
    )


def op12_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return languages(documents(spark, folder))
