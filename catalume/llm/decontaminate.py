"""Benchmark decontamination: rare n-gram seeds, then local alignment.

Word trigrams of the test items are the seeds. A first pass over all documents
counts the contexts (the words before and after) in which each seed occurs. A seed
is rare if it has few contexts for the size of the corpus, or if one context makes
up most of its occurrences: a passage that was copied a thousand times stays rare,
a turn of phrase does not. A second pass joins passages to items by their rare
seeds and scores each with Smith-Waterman over words, which finds edited copies.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from catalume.llm.common import free_name, release, stage

N = 3
#: Characters that don't count at the ends of a word.
EDGES = ".,;:!?\"'()[]{}*$%&#|<>-"
#: Words that a task remembers before it starts afresh.
CACHE = 150_000


def normalised(text: str | None) -> list[str]:
    return [x for x in (w.strip(EDGES).lower() for w in (text or "").split()) if x]


class _Ids(dict):
    """Raw word to the id of its normal form: -1 if no item has it, -2 if nothing is left of it."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, raw: str) -> int:
        word = raw.strip(EDGES).lower()
        found = self[raw] = self.vocabulary.get(word, -1) if word else -2
        return found


class Items:
    """Test items as arrays of word ids, and their seeds as numbers."""

    def __init__(self, rows: list[tuple[object, str | None]]):
        self.names, texts = [], []
        for name, text in rows:
            w = normalised(text)
            if w:
                self.names.append(name)
                texts.append(w)
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        self.words = [np.array([self.vocabulary[w] for w in t], np.int64) for t in texts]
        self.base = len(self.vocabulary) + 1
        #: Items too short for a seed, by their words.
        self.short = defaultdict(list)
        for i, w in enumerate(self.words):
            if len(w) < N:
                self.short[tuple(w.tolist())].append(i)
        holders = defaultdict(set)
        for i, w in enumerate(self.words):
            for s in self.grams(w).tolist():
                holders[s].add(i)
        self.seeds = np.array(sorted(holders), np.int64)
        self.holders = {s: sorted(x) for s, x in holders.items()}

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """The number of the seed that starts at each place; -1 where a word is in no item."""
        if len(ids) < N:
            return np.empty(0, np.int64)
        a, b, c = ids[:-2], ids[1:-1], ids[2:]
        return np.where((a >= 0) & (b >= 0) & (c >= 0), (a * self.base + b) * self.base + c, -1)

    def read(self, text: str | None, cache: _Ids) -> np.ndarray:
        if len(cache) > CACHE:
            cache.clear()
        ids = np.array(list(map(cache.__getitem__, (text or "").split())), np.int64)
        return ids[ids != -2]

    def hits(self, ids: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in a text which of ``seeds`` (sorted) start."""
        g = self.grams(ids)
        if not len(g) or not len(seeds):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.flatnonzero(g >= 0)
        k = np.minimum(np.searchsorted(seeds, g[at]), len(seeds) - 1)
        at = at[seeds[k] == g[at]]
        return at, g[at]


def smith_waterman(item: np.ndarray, text: np.ndarray, match: float = 2.0, miss: float = -1.0, gap: float = -1.0) -> tuple[float, int]:
    """The best local score and the place in ``text`` where that alignment ends (exclusive)."""
    steps = np.arange(len(text)) * -gap
    row = np.zeros(len(text) + 1)
    best, end = 0.0, 0
    for w in item:
        diagonal = row[:-1] + np.where(text == w, match, miss)
        new = np.maximum(np.maximum(diagonal, row[1:] + gap), 0.0)
        new = np.maximum.accumulate(new + steps) - steps  # gaps in the item
        row = np.concatenate(([0.0], new))
        k = int(new.argmax())
        if new[k] > best:
            best, end = float(new[k]), k + 1
    return best, end


def aligned(items: Items, ids: np.ndarray, rare: np.ndarray, threshold: float) -> list[tuple[int, float, int, int, int]]:
    """(item, score, rare seeds, first word, last word) of each item that a text holds; of items too short for a seed, those that are the whole text."""
    if 0 < len(ids) < N:
        return [(i, 1.0, 0, 0, len(ids) - 1) for i in items.short.get(tuple(ids.tolist()), ())]
    at, seeds = items.hits(ids, rare)
    places = defaultdict(list)
    for p, s in zip(at.tolist(), seeds.tolist(), strict=True):
        for i in items.holders[s]:
            places[i].append((p, s))
    out = []
    for i, found in places.items():
        w = items.words[i]
        n = len(w)
        own = len({s for s in items.grams(w).tolist()})
        need = 1 if own < 6 else 2
        best = (0.0, 0, 0, 0)
        cut = [k for k in range(1, len(found)) if found[k][0] - found[k - 1][0] > 2 * n]
        for a, b in zip([0, *cut], [*cut, len(found)], strict=True):
            kinds = len({s for _, s in found[a:b]})
            if kinds < need:
                continue
            start, stop = max(0, found[a][0] - 2 * n), min(len(ids), found[b - 1][0] + N + 2 * n)
            part = ids[start:stop]
            score, end = smith_waterman(w, part)
            if score / (2.0 * n) > best[0]:
                _, back = smith_waterman(w[::-1], part[:end][::-1])
                best = (score / (2.0 * n), kinds, start + end - back, start + end - 1)
        if best[0] >= threshold:
            out.append((i, *best))
    return out


def _chunks(benchmark: DataFrame, item_id: str, text: str, most: int) -> Iterator[Items]:
    """The items in parts of about ``most`` bytes, so that what is broadcast is bounded."""
    b = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t"))
    total = b.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // most) or 1
    for k in range(n):
        yield Items([tuple(r) for r in b.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).orderBy("i", "t").collect()])


def _rare(docs: DataFrame, items, text: str, contexts_per_million: float, least: int, dominant: float) -> np.ndarray:
    """The seeds that are rare over all documents; at most a part's seeds reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        own, cache = items.value, _Ids(items.value.vocabulary)
        met: Counter = Counter()
        n_words = 0

        def rows() -> pa.RecordBatch:
            keys = list(met)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([met[k] for k in keys], pa.int64())], ["seed", "context", "n"])

        for batch in batches:
            for value in batch.column(0):
                raw = (value.as_py() or "").split()
                ids = np.array(list(map(cache.__getitem__, raw)), np.int64)
                real = np.flatnonzero(ids != -2)
                n_words += len(real)
                at, seeds = own.hits(ids[real], own.seeds)
                word = lambda k, raw=raw, real=real: raw[real[k]].strip(EDGES).lower() if 0 <= k < len(real) else ""
                for p, s in zip(at.tolist(), seeds.tolist(), strict=True):
                    met[s, zlib.crc32(f"{word(p - 1)} {word(p + N)}".encode())] += 1
            if len(cache) > CACHE:
                cache.clear()
            if len(met) > 50_000:
                yield rows()
                met.clear()
        met[-1, 0] += n_words
        yield rows()

    met = docs.select(text).mapInArrow(count, "seed long, context long, n long")
    by_context = met.groupBy("seed", "context").agg(F.sum("n").alias("n"))
    facts = by_context.groupBy("seed").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("n"), F.max("n").alias("most")).collect()
    n_words = next((r["n"] for r in facts if r["seed"] == -1), 0)
    limit = max(least, contexts_per_million * n_words / 1e6)
    return np.array(sorted(r["seed"] for r in facts if r["seed"] >= 0 and (r["contexts"] <= limit or r["most"] >= dominant * r["n"])), np.int64)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text",
    threshold: float = 0.5, contexts_per_million: float = 3.0, least_contexts: int = 10, dominant: float = 0.25, chunk_bytes: int = 16 << 20,
) -> DataFrame:
    """(doc_id, item_id, score, n_seeds, first_word, last_word) for each document and test item it holds.

    score is the alignment's share of a whole copy's score, from ``threshold`` to
    1; words are counted from 0 after normalising. One row for each input row and
    item, so repeated rows repeat. Null and empty texts hold nothing; items of
    one or two words are found where they are a whole text; repeated items each give rows. An empty table on
    either side gives an empty result. Other columns are ignored. The items are
    broadcast in parts of at most ``chunk_bytes``; each part reads the documents
    anew.
    """
    sc = docs.sparkSession.sparkContext
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = T.StructType([T.StructField("doc_id", src.schema["doc_id"].dataType), T.StructField("item_id", benchmark.schema[item_id].dataType), *[T.StructField(c, t) for c, t in (("score", T.DoubleType()), ("n_seeds", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()))]])
    named = to_arrow_type(fields["item_id"].dataType)  # ids keep their type, in batches without a find, too
    out = docs.sparkSession.createDataFrame([], fields)
    for part in _chunks(benchmark, item_id, item_text, chunk_bytes):
        if not part.names:
            continue
        items = sc.broadcast(part)
        rare = sc.broadcast(_rare(src, items, "text", contexts_per_million, least_contexts, dominant))

        def align(batches: Iterator[pa.RecordBatch], items=items, rare=rare) -> Iterator[pa.RecordBatch]:
            release()
            own, seeds = items.value, rare.value
            cache = _Ids(own.vocabulary)
            for batch in batches:
                which, found = [], []
                for k, value in enumerate(batch.column(1)):
                    for row in aligned(own, own.read(value.as_py(), cache), seeds, threshold):
                        which.append(k)
                        found.append(row)
                names = pa.array([own.names[r[0]] for r in found], named)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), names, *[pa.array([r[c] for r in found], t) for c, t in ((1, pa.float64()), (2, pa.int64()), (3, pa.int64()), (4, pa.int64()))]], fields.names)

        out = out.unionByName(src.mapInArrow(align, fields))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with their columns as they are.

    Decisions go by row: rows that share a doc_id, or have none, are told apart.
    """
    key = free_name(docs, "_row")
    numbered = stage(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    found = contaminated(numbered, benchmark, doc_id=key, **options).select(F.col("doc_id").alias(key)).distinct()
    return numbered.join(found, key, "left_anti").select(*docs.columns)
