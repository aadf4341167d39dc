"""The near-dedup stage against Jaccard similarities of all pairs."""

import random

from catalume.llm import jaccard


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return set(zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else {tuple(w)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    group = {i: {i} for i, _ in sets}
    for i, a in sets:
        for k, b in sets:
            if i < k and len(a & b) >= 0.8 * len(a | b) and group[i] is not group[k]:
                both = group[i] | group[k]
                group.update(dict.fromkeys(both, both))
    return {min(g) for g in group.values()}


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = [(-2, None), (-1, "")]
    for n in (3, 6, 40, 100, 300, 1000):
        base = [word() for _ in range(n)]
        for edits in (0, 0, 1, 2, 3, 5, 6, 8, 10, 20):
            copy = list(base)
            for k in rng.sample(range(n), min(n, edits)):
                copy[k] = word()
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.doc_id for r in jaccard.keep_one(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert jaccard.keep_one(docs.limit(0)).count() == 0


def test_chains_and_common_passages(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(9000)}"
    passage, text, rows = [word() for _ in range(60)], [word() for _ in range(200)], []
    for k in range(40):
        text = list(text)
        text[5 * k] = word()  # each links to the one before, not to the first
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(passage + [word() for _ in range(20)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in jaccard.keep_one(docs).collect()} == brute(rows)


def test_a_passage_of_many_texts_makes_few_pairs(spark, monkeypatch):
    """Where counts of buckets say nothing (one bucket for all), texts aren't paired by a passage that many have."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(90_000)}"
    passage, rows = [word() for _ in range(100)], []
    for k in range(60):
        text = passage + [word() for _ in range(300)]
        rows.append((len(rows), " ".join(text)))
        if k % 6 == 0:  # some linked, some just not
            for i in rng.sample(range(400), 5 + k // 4):
                text[i] = word()
            rows.append((len(rows), " ".join(text)))
    made, stage = [], jaccard.stage
    monkeypatch.setattr(jaccard, "stage", lambda df, name: (out := stage(df, name), name == "pairs" and made.append(out.count()))[0])
    texts = spark.createDataFrame([(i, i, t) for i, t in rows], "row long, name long, text string")
    kept = {r.row for r in jaccard.near_copies(texts, buckets=1).where("row = first").collect()}
    as_before = {r.row for r in jaccard.near_copies(texts, buckets=1, crowded=10**9).where("row = first").collect()}
    assert kept == as_before == brute(rows) and 60 < len(kept) < 70
    assert made[0] <= len(rows) < 1000 < made[1]
