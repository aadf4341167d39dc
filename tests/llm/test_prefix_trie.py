import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from catalume.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n_convs string, id string, block string"
EXTRA = (None, "x", None, "y")


def rebuilt(rows):
    """Conversations rebuilt as the operator defines it, from (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[: heads[c]] + turns[heads[c] :] for c, turns in own.items()}


def trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    below = {p: [q for q in members if q[: len(p)] == p] for p in members}
    out = []
    for p, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(convs[c]) == len(p))))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below[p] if q)
        leaves = sum(len(below[q]) == 1 for q in below[p])
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), sum(len(q) == len(p) + 1 for q in below[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


def check(spark, rows):
    got = [tuple(r) for r in prefix_trie.conversation_trie(made(spark, rows)).collect()]
    assert sorted(got, key=str) == trie(rebuilt(rows))


def test_random_conversations_with_nulls_ties_and_repeats(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(60), -3, -5, -12, 10**12, 10**12 + 1]:
        for k in range(rng.choice([1, 2, 4, 9, 17, 30])):
            rows.append((c, rng.choice([k, k, k, None, 0]), rng.choice(["user", "user", None, ""]), rng.choice(["a", "a", "b", "é", None, ""])))
    check(spark, rows + rows[:5] + [(None, 1, "user", "a"), (7, 1, "user", "long " * 100_000), (12, 1, "user", "long " * 100_000)])


def test_copies_deep_branches_and_conversations_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "FAN", 3)  # several levels of the tree of digests
    monkeypatch.setattr(prefix_trie, "RUN", 2)
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)  # ids of one node in several strings
    long_ = [("user", str(k)) for k in range(150)]
    rows = [(c, k, *t) for c in range(0, 100, 5) for k, t in enumerate(long_)]  # exact copies
    rows += [(c, k, *t) for i, c in enumerate(range(100, 160, 5)) for k, t in enumerate([*long_[: 10 * i], ("user", f"own {c}")])]  # ever later branches
    rows += [(c, 0, "user", "x") for c in range(200, 260, 5)]
    check(spark, rows)


def test_roles_and_texts_do_not_run_together(spark):
    check(spark, [(0, 1, "a", "bc"), (5, 1, "ab", "c"), (10, 1, "a:", "b"), (15, 1, "a", ":b"), (20, 1, "", "abc"), (25, 1, None, "abc")])


def test_no_conversations(spark):
    assert prefix_trie.conversation_trie(made(spark, [])).count() == 0
    assert prefix_trie.conversation_trie(made(spark, [(None, 1, "user", "a")])).count() == 0


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_pivot_search", "op13_hard_negatives"])
def test_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("conversations", "embeddings"):
        con.sql(f"create view {table} as select * from '{sf}/{table}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = con.sql(f"select {', '.join(columns)} from ({queries.SQL[name]})").fetchall()
    assert want and sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(want, key=str)


def test_sql_on_odd_rows(spark):
    rng = random.Random(4)
    rows = [(c, rng.choice([None, 1, 2]), rng.choice(["user", None]), rng.choice(["a", "", None, "b"])) for c in [*range(30), None] for _ in range(5)]
    con = duckdb.connect()
    con.register("conversations", made(spark, rows).select("conv_id", "turn", "role", "text").toArrow())
    got = prefix_trie.conversation_trie(made(spark, rows))
    want = con.sql(f"select {', '.join(got.columns)} from ({prefix_trie.SQL})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert got.where(F.col("depth") == 0).count() == 1
