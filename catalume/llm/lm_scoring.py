"""Scores of whole documents by a self-attention model and by word frequencies.

Documents whose crc32(doc_id as text) mod 5 is not 1 are learned from. One pass over
them counts all words, all first ids of words and their neighbours, and cuts every
document's first ids into parts for training; what is gathered grows with the corpus.
Tasks train on their shares of the parts from common weights, which are averaged after
each round; every word of every training document is trained on once, at any size. One
pass over all documents then scores them: the model gives the class of each word, the
word's count its share of the class. Counts of frequent words (a bounded list) are
broadcast; all others meet their counts in a join.
"""

from __future__ import annotations

import io
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalume.llm import attention as att
from catalume.llm.bpe import read_ranks
from catalume.llm.common import release, stage

#: Fixed values of the folds.
FOLDS, HELD_OUT = 5, 1
ROUNDS = 3
#: Words that a part of a document trains on, and words that a task trains on in a round; the number of tasks grows with the corpus.
PART, PER_TASK = 8 * att.SPAN, 800_000
#: Ids before a part that are read but not predicted, after the one that begins it.
BACK = att.SPAN
#: Tasks that add up weights.
ADDERS = 16
#: Words whose counts are broadcast at most.
FREQUENT = 200_000
#: Words that a task remembers, and words handled at a time.
CACHE, AT_ONCE = 300_000, 200_000
#: New words that are encoded together.
TOGETHER = 2000


def words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lower-cased; bytes are cut at ASCII white space only."""
    return (text or b"").lower().split()


class Words(dict):
    """Word to a number; beside it the word's hash and the first of its ids, once ``settle`` has seen to new words. Number 0 is the end."""

    def __init__(self, tokens: list[bytes], pattern: str, end: int):
        import tiktoken
        import xxhash

        own = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
        if max(end, own.n_vocab - 1) >= 1 << 16:
            raise ValueError("ids are kept as 16 bits; the vocabulary is larger")
        self.encode, self.end, self.digest = own.encode_ordinary, end, xxhash.xxh64_intdigest
        self.spaced = np.array([t[:1] == b" " for t in tokens])
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self._hashes, self._first = array("Q", [0]), array("H", [self.end])

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        n = self[word] = len(self) + 1
        return n

    @property
    def hashes(self) -> np.ndarray:
        return np.array(self._hashes, np.uint64).view(np.int64)

    @property
    def first(self) -> np.ndarray:
        return np.array(self._first, np.int64)

    def settle(self) -> None:
        """Hashes and first ids of the words met since the last time. Words are encoded with a space before each, many at once: no id crosses such a space."""
        for a in range(0, len(self.new), TOGETHER):
            some = self.new[a : a + TOGETHER]
            self._hashes.extend([self.digest(w) or 1 for w in some])
            text = " " + b" ".join(some).decode()
            ids = np.array(self.encode(text), np.int64) if len(text.split()) == len(some) else np.empty(0, np.int64)
            first = ids[self.spaced[ids]]
            if len(first) != len(some):  # other white space in a word
                first = np.array([self.encode(" " + w.decode())[0] for w in some])
            self._first.frombytes(first.astype(np.uint16).tobytes())
        self.new = []


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _batches(batches: Iterator[pa.RecordBatch], column: int, table: Words):
    """(rows of the batch, word numbers, ends of documents in them) for parts of each batch."""
    for batch in batches:
        numbers, ends, first = array("q"), [], 0
        for k, value in enumerate(batch.column(column).cast(pa.binary())):
            numbers.extend(map(table.__getitem__, words(value.as_py())))
            numbers.append(0)
            ends.append(len(numbers))
            if len(numbers) >= AT_ONCE or k + 1 == batch.num_rows:
                table.settle()
                yield batch.slice(first, k + 1 - first), np.array(numbers, np.int64), np.array(ends, np.int64)
                numbers, ends, first = array("q"), [], k + 1
                if len(table) > CACHE:
                    table.reset()


def gather(docs: DataFrame, tokens, pattern: str, end: int) -> DataFrame:
    """(kind, key, n, first, ids) of the training documents ``docs`` (text).

    Kind 0: counts of words by hash, with their first id. Kind 1: counts of first ids,
    with those of the buckets of their neighbours before and after. Kind 2: parts of
    documents as first ids; n ids at the start are only read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        table = Words(tokens.value, pattern, end)
        by_word = np.zeros(1, np.int64)
        company = np.zeros((end + 1, 2 * att.BUCKETS), np.int32)

        def rows(kind: int, keys, n, first=None, ids=None) -> pa.RecordBatch:
            size = len(n)
            none = np.zeros(size, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), pa.array(none if keys is None else keys), pa.array(n, pa.int64()), pa.array(none if first is None else first), pa.array([None] * size if ids is None else ids, pa.binary())], ["kind", "key", "n", "first", "ids"])

        def counted() -> pa.RecordBatch:
            found = np.flatnonzero(by_word)
            return rows(0, table.hashes[found], by_word[found], table.first[found])

        for _, numbers, ends in _batches(batches, 0, table):
            ids = table.first[numbers]
            now = np.bincount(numbers, minlength=len(table) + 1)
            now[: len(by_word)] += by_word
            by_word = now
            before = att.bucket(np.concatenate([[end], ids[:-1]]))
            after = att.bucket(np.concatenate([ids[1:], [end]]))
            flat = company.reshape(-1)
            for at in (ids * (2 * att.BUCKETS) + before, ids * (2 * att.BUCKETS) + att.BUCKETS + after):
                met, n = np.unique(at, return_counts=True)
                flat[met] += n.astype(np.int32)
            parts, leads, start, small = [], [], 0, ids.astype(np.uint16)
            for stop in ends.tolist():
                for a in range(start, stop, PART):
                    lead = 0 if a == start else BACK + 1
                    parts.append(small[a - lead : min(stop, a + PART)].tobytes())
                    leads.append(lead)
                start = stop
            yield rows(2, None, leads, ids=parts)
            if len(table) > CACHE:  # the table starts afresh after this part
                yield counted()
                by_word = np.zeros(1, np.int64)
        yield counted()
        met = np.flatnonzero(company.any(1))
        yield rows(1, met, company[met, : att.BUCKETS].sum(1), ids=[r.tobytes() for r in company[met]])

    return stage(docs.mapInArrow(count, "kind int, key long, n long, first long, ids binary"), "gathered")


def pack(w: att.Weights) -> bytes:
    out = io.BytesIO()
    np.savez(out, **w)
    return out.getvalue()


def unpack(data: bytes) -> att.Weights:
    with np.load(io.BytesIO(data)) as f:
        return {k: f[k] for k in f.files}


def company(known: DataFrame, members: np.ndarray) -> np.ndarray:
    """What neighbours the first ids ``members`` have in all training documents: a row of counts for each."""
    asked = frozenset(members.tolist())  # at most ``CLUSTERED``

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key in asked:
                    total[key] = total.get(key, 0) + np.frombuffer(row.as_py(), np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.astype(np.float64).tobytes() for x in total.values()], pa.binary())], ["key", "row"])

    met = known.where("kind = 1").select("key", "ids").repartition("key").mapInArrow(add, "key long, row binary").collect()
    at = {m: k for k, m in enumerate(members.tolist())}
    out = np.zeros((len(members), 2 * att.BUCKETS))
    for r in met:
        out[at[r["key"]]] = np.frombuffer(bytes(r["row"]))
    return out


def deal(parts: DataFrame, rounds: int, k: int, tasks: int) -> DataFrame:
    """Round ``k``'s share of ``parts`` (n, ids) in ``tasks`` even partitions. Equal parts are dealt apart: by row number to rounds, then in turn."""
    lot = F.xxhash64("ids", F.monotonically_increasing_id())
    return parts.where(F.pmod(lot, F.lit(rounds)) == k).repartition(tasks)


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, weights) summed over rows (n, loss, weights), weighted by n; one row at a time."""
    seen, total = 0, None
    for batch in batches:
        for n, packed in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            w = unpack(packed.as_py())
            seen += n
            total = {name: n * x.astype(np.float64) + (0 if total is None else total[name]) for name, x in w.items()}
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([pack(total)], pa.binary())], ["n", "weights"])


def blocks(leads: list[int], parts: list[bytes], vocabulary: att.Vocabulary, end: int) -> att.Blocks:
    """Parts of documents (of which the first ``leads`` ids are only read) as blocks."""
    ids = [np.frombuffer(p, np.uint16).astype(np.int64) for p in parts]
    begins = np.array([x[0] if lead else end for x, lead in zip(ids, leads, strict=True)], np.int64)
    ids = [x[1:] if lead else x for x, lead in zip(ids, leads, strict=True)]
    return att.Blocks.of(np.concatenate(ids), np.cumsum([len(x) for x in ids]), begins, np.maximum(0, np.array(leads) - 1), vocabulary)


def fit(parts: DataFrame, vocabulary: att.Vocabulary, total: int, *, end: int, rounds: int = ROUNDS, per_task: int = PER_TASK, rate: float = 0.02) -> att.Weights:
    """Train on ``parts`` (n, ids) with ``total`` words in parallel: in each round every task starts from the mean of the last round's weights.

    A round is one pass over its share of the parts, read batch by batch. The
    weights of a round are added up by a fixed number of tasks, one row each for the
    driver.
    """
    spark = parts.sparkSession
    tasks = max(1, -(-total // (rounds * per_task)))
    steps = max(1, -(-total // (tasks * rounds * att.BATCH * att.SPAN)))
    w = att.start(vocabulary)
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((vocabulary, pack(w), k))

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            release()
            voc, packed, number = shared.value
            rng, seen = np.random.default_rng(number), 0

            def read():
                nonlocal seen
                for b in batches:  # shuffled within an Arrow batch
                    if b.num_rows:
                        cut = blocks(b.column(0).to_pylist(), b.column(1).to_pylist(), voc, end)
                        seen += int((cut.kinds >= 0).sum())
                        yield from cut.batches(rng)

            new, loss = att.train(unpack(packed), read(), steps=steps, rate=rate / (1 + number))
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([float(loss)]), pa.array([pack(new)], pa.binary())], ["n", "loss", "weights"])

        trained = stage(deal(parts, rounds, k, tasks).mapInArrow(step, "n long, loss double, weights binary"), "trained")
        got = trained.coalesce(ADDERS).mapInArrow(add_up, "n long, weights binary").collect()
        if got:
            seen = sum(r["n"] for r in got)
            sums = [unpack(bytes(r["weights"])) for r in got]
            w = {name: (sum(p[name] for p in sums) / seen).astype(np.float32) for name in w}
    return w


def frequent(by_word: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) and counts of the most frequent words, at most ``most``: all whose count reaches a threshold."""
    level = F.floor(F.log2("c") * 16).cast("int")
    sizes = by_word.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 16 x 63 rows
    least, taken = None, 0
    for r in sorted(sizes, key=lambda r: -r["level"]):
        taken += r["n"]
        if taken > most:
            break
        least = r["level"]
    if least is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    top = by_word.where(level >= least).select("key", "c").toPandas()
    order = np.argsort(top["key"].to_numpy(np.int64), kind="stable")
    return top["key"].to_numpy(np.int64)[order], top["c"].to_numpy(np.int64)[order]


@dataclass
class Model:
    """What has been learned: counts of words (key, c), their number and that of distinct ones, and the attention model."""

    by_word: DataFrame
    words: int
    distinct: int
    vocabulary: att.Vocabulary
    weights: att.Weights
    #: Base-10 logarithm of each class's size, smoothed as the base's.
    sizes: np.ndarray


def learn(docs: DataFrame, tokens, pattern: str, *, end: int) -> Model:
    """A model of the documents ``docs`` (text): all of them, whole."""
    known = gather(docs, tokens, pattern, end)
    by_word = stage(known.where("kind = 0").groupBy("key").agg(F.sum("n").alias("c"), F.min("first").alias("first")), "counts")
    facts = by_word.groupBy("first").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()  # at most one row for each id
    counts, distinct = np.zeros(end + 1), np.zeros(end + 1)
    for r in facts:
        counts[r["first"]], distinct[r["first"]] = r["n"], r["v"]
    order = np.argsort(-counts[:-1], kind="stable")[: att.CLUSTERED]
    members = order[counts[order] >= att.MET]
    vocabulary = att.Vocabulary.of(counts, company(known, members), members)
    total = int(counts.sum())
    weights = fit(known.where("kind = 2").select("n", "ids"), vocabulary, total, end=end)
    n, v = (np.bincount(vocabulary.kind, x, att.CLASSES) for x in (counts, distinct))
    return Model(by_word, total, int(distinct.sum()), vocabulary, weights, np.log10(n + 0.5 * (v + 1)))


def score_documents(docs: DataFrame, ranks_path: str, pattern: str, *, text: str = "text", doc_id: str = "doc_id", end: int = 50256, model: Model | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    base_score and score are log10 probabilities of the whole text: of its words by
    their counts in the training documents alone, and by the model, which gives each
    word's class from the subword ids before it and the word its share of the class.
    Null and empty texts are one end. A null doc_id is learned from. Repeated rows
    each get their row and count each time. An empty table gives an empty result;
    other columns are ignored.
    """
    spark = docs.sparkSession
    tokens = spark.sparkContext.broadcast(read_ranks(ranks_path))
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), _held_out(F.col(doc_id)).alias("held_out"))
    model = model or learn(src.where(~F.col("held_out")).select("text"), tokens, pattern, end=end)
    by_word, n, v = model.by_word, model.words, model.distinct
    shared = spark.sparkContext.broadcast((*frequent(by_word, FREQUENT), model.vocabulary, model.weights, model.sizes))
    z = float(np.log10(n + 0.5 * (v + 1)))
    fields = T.StructType([T.StructField("doc_id", src.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()), *[T.StructField(c, t) for c, t in (("n_tokens", T.LongType()), ("n_frequent", T.LongType()), ("base", T.DoubleType()), ("classes", T.DoubleType()), ("rare", T.ArrayType(T.LongType())))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        keys, found, voc, weights, sizes = shared.value
        table, scorer = Words(tokens.value, pattern, end), att.Scorer(weights, voc)
        for part, numbers, ends in _batches(batches, 2, table):
            hashes, first = table.hashes, table.first
            k = np.minimum(np.searchsorted(keys, hashes), max(0, len(keys) - 1))
            is_frequent = keys[k] == hashes if len(keys) else np.zeros(len(hashes), bool)
            worth = np.where(is_frequent, np.log10((found[k] if len(keys) else 0) + 0.5), 0.0)
            lengths = np.diff(ends, prepend=0)
            summed = lambda x, ends=ends, lengths=lengths: (s := np.concatenate([[0], np.cumsum(x)]))[ends] - s[ends - lengths]
            ids = first[numbers]
            classes = scorer.score(ids, ends, end) / np.log(10) - summed(sizes[voc.kind[first]][numbers])
            other = ~is_frequent[numbers]
            rare_ends = np.concatenate([[0], np.cumsum(other)[ends - 1]]).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(rare_ends), pa.array(hashes[numbers[other]]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lengths), pa.array(summed(is_frequent[numbers])), pa.array(summed(worth[numbers])), pa.array(classes), rare], fields.names)

    scored = stage(src.select("doc_id", "held_out", "text").mapInArrow(run, fields).withColumn("_row", F.monotonically_increasing_id()), "scored")
    asked = scored.select("_row", F.explode("rare").alias("key"))
    met = asked.join(by_word, "key").groupBy("_row").agg(F.sum(F.log10(F.col("c") + 0.5) - float(np.log10(0.5))).alias("_more"), F.count(F.lit(1)).alias("_known"))
    out = scored.withColumn("_rare", F.size("rare")).drop("rare").join(met, "_row", "left")
    worth = F.col("base") + F.coalesce("_more", F.lit(0.0)) + F.col("_rare") * float(np.log10(0.5))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_frequent") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (worth - F.col("n_tokens") * z).alias("base_score"), (worth + F.col("classes")).alias("score"),
    )
