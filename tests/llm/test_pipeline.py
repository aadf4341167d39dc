"""The pipeline against the decisions of its stages, applied by brute force, and every stage on odd rows."""

import corpus_pipeline
from catalume.llm import bpe, decontaminate, quality, surrogates
from catalume.llm.queries import SECRET, pattern, ranks
from tests.llm.test_jaccard import brute

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    left = {r.doc_id for r in quality.classify(docs, labels).where("kept").collect()}
    left = brute([(i, text[i]) for i in sorted(left)])  # one of each group of a Jaccard similarity of 0.8 or more
    leaks = [decontaminate.normalised(r.text) for r in items.collect()]
    whole = lambda t: any(" ".join(x) in " ".join(decontaminate.normalised(t)) for x in leaks)
    assert set(got) <= left and left - set(got) == {i for i in left if whole(text[i])}
    encoder = bpe.BytePairEncoder(bpe.read_ranks(ranks()), pattern())
    changed = {r.doc_id: r.text for r in surrogates.pseudonymise(docs.where(docs.doc_id.isin(list(got))), SECRET).collect()}
    for i, r in got.items():
        assert r.n_tokens == len(r.token_ids)
        if not surrogates.entities(text[i]):
            assert list(r.token_ids) == encoder.encode(text[i])
        else:
            assert not any(text[i][a:b] in encoder.decode(r.token_ids).decode() for a, b, *_ in surrogates.entities(text[i])) and changed[i] != text[i]


def test_every_stage_on_odd_rows(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing names; then no rows at all."""
    long = " ".join(f"w{k}" for k in range(20_000))
    rows = [(1, None), (2, ""), (3, " \n"), (None, "one two three"), (None, "one two three"), (4, "same words here again"), (4, "same words here again"), (4, "quite another text of the same number"), (5, long), (6, long + " end")]
    extra = ("kept", "posterior", "row", "name", "size", "digest", "group", "_row", "fp", "n_entities", "n_tokens")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["x"] * len(extra)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra))
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, SF), stage(spark, docs.limit(0), SF)
        assert none.count() == 0 and none.columns == out.columns, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        if "near-dedup" in name:
            assert sorted((r.doc_id, (r.text or "")[:9]) for r in out.collect() if r.doc_id) == [(1, ""), (4, "quite ano"), (4, "same word"), (5, "w0 w1 w2 ")] and out.count() == 5
        elif "quality" not in name:
            assert out.count() == len(rows), name
