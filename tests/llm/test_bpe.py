import hashlib
import random

import pytest
import public_tokenizers
import tiktoken

from catalume.llm import bpe
from catalume.llm.queries import pattern, ranks


@pytest.fixture(scope="module")
def both():
    tokens = bpe.read_ranks(ranks())
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    return bpe.BytePairEncoder(tokens, pattern()), known


def test_equals_the_merge_order_on_random_text(both):
    own, known = both
    rng = random.Random(5)
    pools = ["abcdeth in on", "aaaaab", "éèçñß ıİ漢字かな🙂‍", "\x1c\x1d\x85  \t\n\r x", "0123456789.,;!?*$'sS'tTll "]
    for _ in range(1500):
        text = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(90)))
        assert own.encode(text) == known.encode_ordinary(text), repr(text)
        assert own.decode(own.encode(text)) == text.encode()


def test_every_token_and_long_runs(both):
    own, known = both
    for token in own.tokens[::37]:
        text = token.decode("utf-8", "replace")
        assert own.encode(text) == known.encode_ordinary(text)
    for text in ("a" * 50_000, " " * 30_001 + "x", "ab" * 20_000, "<|endoftext|>", "='" * 900):
        assert own.encode(text) == known.encode_ordinary(text)


def test_table_edges(spark, both):
    own, known = both
    rows = [(1, None, "x"), (2, "", "y"), (None, "Hello  world", "z"), (3, "same", "a"), (3, "same", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, bpe.encode_documents(docs, ranks(), pattern(), digests=True).collect()), key=str)
    want = []
    for i, text, _ in rows:
        ids = known.encode_ordinary(text or "")
        want.append((i, len(ids), ids, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode_documents(docs.limit(0), ranks(), pattern()).count() == 0


def test_decode_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    back = bpe.decode_documents(bpe.encode_documents(docs, ranks(), pattern()), ranks())
    assert back.join(docs.select("doc_id", docs.text.alias("was")), "doc_id").where("not (text <=> was)").count() == 0
