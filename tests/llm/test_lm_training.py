"""What the language model learns from, and its scores against a plain loop."""

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalume.llm import attention, bpe, lm_scoring
from catalume.llm.queries import END, pattern, ranks

SF = "/root/testdata/sf0.001"


def cut(text):
    """Words, lower-case where A-Z, and an end."""
    return [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x] + [None]


def test_every_word_of_every_document_is_a_target_once(spark):
    tokens = spark.sparkContext.broadcast(bpe.read_ranks(ranks()))
    encoder = bpe.BytePairEncoder(tokens.value, pattern())
    texts = ["", None, "short text", "same opening " * 40 + "one", "same opening " * 400 + "two " * 300, "x\u00a0y \u3042\u00e9 Z"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = lm_scoring.gather(docs, tokens, pattern(), END).collect()
    first = lambda w: END if w is None else encoder.encode(" " + w)[0]
    want = collections.Counter(first(w) for t in texts for w in cut(t))
    counts = collections.Counter()
    for r in got:
        if r.kind == 1:
            counts[r.key] += r.n
            assert np.frombuffer(r.ids, np.int32).sum() == 2 * r.n  # a neighbour on either side
    assert counts == want
    parts = [r for r in got if r.kind == 2]
    kinds = np.arange(END + 1, dtype=np.int32)
    voc = attention.Vocabulary(np.zeros(END + 1, np.int32), kinds, np.zeros(1))
    blocks = lm_scoring.blocks([r.n for r in parts], [bytes(r.ids) for r in parts], voc, END)
    assert collections.Counter(blocks.kinds[blocks.kinds >= 0].tolist()) == want
    assert all(len(r.ids) // 2 <= lm_scoring.PART + lm_scoring.BACK + 1 for r in parts)


def test_equal_parts_are_dealt_evenly(spark):
    part = np.full(40, 5, np.uint16).tobytes()
    parts = lm_scoring.stage(spark.range(9000).select(F.lit(0).alias("n"), F.lit(part).alias("ids")), "equal")
    shares = [lm_scoring.deal(parts, 3, k, 4).groupBy(F.spark_partition_id()).count().collect() for k in range(3)]
    sizes = [[r["count"] for r in s] for s in shares]
    assert sum(map(sum, sizes)) == 9000 and all(len(s) == 4 and 600 < min(s) and max(s) < 900 for s in sizes)


def test_tasks_grow_with_the_words_and_weights_are_means(spark, monkeypatch):
    rng = np.random.default_rng(3)
    counts = rng.integers(6, 50, 300).astype(float)
    voc = attention.Vocabulary.of(counts, rng.random((200, 128)), np.arange(200))
    parts = lm_scoring.stage(spark.createDataFrame([(0, rng.integers(0, 300, 20).astype(np.uint16).tobytes()) for _ in range(3000)], "n long, ids binary"), "few")
    met = []
    real = lm_scoring.deal
    monkeypatch.setattr(lm_scoring, "deal", lambda w, rounds, k, tasks: met.append(tasks) or real(w, rounds, k, tasks))
    out = lm_scoring.fit(parts, voc, 60_000, end=299, per_task=1000)
    assert met == [20] * 3 and all(np.isfinite(x).all() and x.dtype == np.float32 for x in out.values())
    rows = [lm_scoring.pack({"a": np.full(2, x, np.float32)}) for x in (1, 4)]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 3]), pa.array([0.0, 0.0]), pa.array(rows, pa.binary())], ["n", "loss", "weights"])
    (got,) = lm_scoring.add_up(iter([batch]))
    assert (lm_scoring.unpack(got.column(1)[0].as_py())["a"] / got.column(0)[0].as_py() == 3.25).all()


def test_frequent_words_are_those_above_a_threshold(spark):
    rows = spark.createDataFrame([(k, c) for k, c in enumerate([9, 1, 50, 1, 7000, 3])], "key long, c long")
    assert [x.tolist() for x in lm_scoring.frequent(rows, 3)] == [[0, 2, 4], [9, 50, 7000]]
    assert [x.tolist() for x in lm_scoring.frequent(rows, 0)] == [[], []] and len(lm_scoring.frequent(rows, 99)[0]) == 6


def test_scores_equal_a_plain_loop_over_windows(spark):
    """The same weights, one word at a time, every word with the block before it and what comes before it in its own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tokens = spark.sparkContext.broadcast(bpe.read_ranks(ranks()))
    model = lm_scoring.learn(docs.where(~lm_scoring._held_out(F.col("doc_id"))).select("text"), tokens, pattern(), end=END)
    got = {r.doc_id: r.score for r in lm_scoring.score_documents(docs, ranks(), pattern(), model=model).collect()}
    encoder = bpe.BytePairEncoder(tokens.value, pattern())
    words = {r.doc_id: cut(r.text) for r in docs.collect()}
    first = {w: END if w is None else encoder.encode(" " + w)[0] for t in words.values() for w in t}
    counts = collections.Counter(w for i, t in words.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    voc, w = model.vocabulary, {k: x.astype(float) for k, x in model.weights.items()}
    kind = lambda x: int(voc.kind[first[x]])
    in_class, distinct = collections.Counter(), collections.Counter()
    for x, c in counts.items():
        in_class[kind(x)] += c
        distinct[kind(x)] += 1
    d, span = attention.WIDTH, attention.SPAN
    table = w["E"] @ w["T"]
    for i in sorted(words, key=lambda i: len(words[i]))[::9]:
        read = [int(voc.unit[END])] + [int(voc.unit[first[x]]) for x in words[i][:-1]]
        total = 0.0
        for t, x in enumerate(words[i]):
            a = max(0, t // span * span - span)
            q = table[read[t], :d]
            s = np.array([q @ table[read[k], d : 2 * d] / d**0.5 + w["bias"][t % span, k - (t // span * span - span)] for k in range(a, t + 1)])
            s = np.exp(s - s.max())
            context = sum(p * table[read[k], 2 * d : 3 * d] for p, k in zip(s / s.sum(), range(a, t + 1), strict=True))
            y = np.maximum(context @ w["B"] + table[read[t], 3 * d :] + w["c"], 0) @ w["O"] + w["o"]
            of_class = y[kind(x)] - np.log(np.exp(y).sum())
            total += of_class / np.log(10) + np.log10((counts[x] + 0.5) / (in_class[kind(x)] + 0.5 * (distinct[kind(x)] + 1)))
        assert got[i] == pytest.approx(total, rel=1e-4)


def test_score_beats_word_frequencies_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    base, score, n = lm_scoring.score_documents(docs, ranks(), pattern()).where("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert score / n > base / n + 0.2
