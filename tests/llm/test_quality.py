"""The classifier's posteriors against plain sums, its sites and its odd inputs."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalume.llm import quality

SF = "/root/testdata/sf0.001"


def brute(rows, levels):
    """rows of (evidence, site): the posterior of each by the formulas of empirical Bayes, from plain sums."""
    p = [1 / (1 + math.exp(-z)) for z, _ in rows]
    sums = [collections.defaultdict(lambda: [0, 0.0, 0.0]) for _ in range(levels + 1)]
    for x, (_, site) in zip(p, rows, strict=True):
        for d in range(levels + 1):
            s = sums[d][site[:d]]
            s[0], s[1], s[2] = s[0] + 1, s[1] + x, s[2] + x * x
    n, total, _ = sums[0][()]
    prior = min(max(total / n, 1e-6), 1 - 1e-6)
    noise = max(1e-9, sum(q - s * s / m for m, s, q in sums[1].values()) / max(1, n - len(sums[1])))
    worth = []
    for d in range(1, levels + 1):
        above = lambda site, d=d: sums[d - 1][site[: d - 1]]
        mean = lambda site, d=d: above(site)[1] / above(site)[0] if d > 1 else prior
        squares = sum(m * m / above(site)[0] for site, (m, _, _) in sums[d].items())
        spread = sum(m * (s / m - mean(site)) ** 2 for site, (m, s, _) in sums[d].items())
        parents = len(sums[d - 1])
        if len(sums[d]) <= parents or n <= squares:
            worth.append(1e12)
            continue
        between = (spread - (len(sums[d]) - parents) * noise) / (n - squares)
        worth.append(1e12 if between <= 1e-12 else max(1e-3, noise / between))
    out = []
    for x, (z, site) in zip(p, rows, strict=True):
        post = prior
        for d, k in enumerate(worth, 1):
            m, s, _ = sums[d][site[:d]]
            post = min(max((s - x + k * post) / (m - 1 + k), 1e-6), 1 - 1e-6)
        out.append(1 / (1 + math.exp(-(z - math.log(prior / (1 - prior)) + math.log(post / (1 - post))))))
    return out


def test_posteriors_equal_plain_sums(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels, keep=("doc_id", "source", "lang")).collect()
    want = brute([(r.evidence, (r.source, r.lang)) for r in got], 2)
    assert [r.posterior for r in got] == pytest.approx(want, rel=1e-6) and [r.kept for r in got] == [x >= 0.5 for x in want]


def test_hosts_and_paths_of_addresses(spark):
    rows = [("https://www.A.org/x/y/z.html", "a.org", "x", "x/y"), ("http://a.org/x", "a.org", "x", "x"), ("http://a.org", "a.org", "", ""), ("not an address", None, "not an address", "not an address"), (None, None, "", "")]
    out, names = quality.url_levels(spark.createDataFrame(rows, "url string, h string, p1 string, _site0 string"), "url")
    assert len(set(names)) == 3 and "_site0" not in names
    got = [tuple(r[n] for n in names) for r in out.collect()]
    assert got[:3] == [r[1:] for r in rows[:3]] and got[3][0] is None and got[4][0] is None


def test_pages_by_host_and_two_path_levels(spark):
    """Pages have addresses; the posteriors at three levels equal plain sums."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumn("site", F.expr("'http://h' || page_id % 5 || '.org/a' || page_id % 3 || '/b' || page_id % 2"))
    for column in ("url", "site"):
        docs, levels = quality.url_levels(pages, column)
        model = quality.Model({}, np.linspace(-3, 3, quality.SHAPES), 0.2, 0.5)
        got = quality.classify(docs, None, model=model, text="html", doc_id="page_id", levels=levels, keep=("page_id", *levels)).collect()
        want = brute([(r.evidence, tuple(r[c] for c in levels)) for r in got], 3)
        assert len(got) == pages.count() and [r.posterior for r in got] == pytest.approx(want, rel=1e-6)


def test_clashing_names_repeated_rows_and_empty_tables(spark):
    rows = [(1, "good text here", "s", "en", "x", 1.0, True)] * 3 + [(None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, kept string, posterior double, evidence boolean")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    rated = quality.classify(docs, labels, keep=tuple(docs.columns))
    assert rated.columns == [*docs.columns, "evidence_", "host_posterior", "path_posterior", "posterior_", "kept_"] and rated.count() == 4
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.keep_good(docs.limit(0), labels).count() == quality.keep_good(docs.limit(0), labels.limit(0)).count() == 0


def test_repeated_ids_are_one_row_to_learn_from(spark):
    """Rows that share a labelled id don't outweigh the others, nor reach the driver."""
    rows = [(k, f"{'good' if k % 2 else 'bad'} text number {k}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    more = docs.union(docs.where("doc_id = 1").crossJoin(spark.range(500)).select("doc_id", "text"))
    once, often = (quality.train(d, labels, toxic=None) for d in (docs, more))
    assert once.intercept == pytest.approx(often.intercept, abs=1e-3) and once.prior == often.prior
