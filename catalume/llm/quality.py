"""Quality classifier with hierarchical empirical Bayes.

A logistic model over word presence and shape gives each document's evidence. The
posteriors of its host and of the path below the host are estimated from all
documents by grouped sums: each level is shrunk towards the one above by as much
as the spread between its members, beyond what chance explains, allows. A document's
own evidence is left out of its site's sums before the two are combined.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalume.llm.common import free_name, release, stage

EDGES = ".,;:!?\"'()[]{}"
CACHE = 150_000
SHAPES = 8


def shape(text: str, w: list[str]) -> list[float]:
    """How a text looks: all from 0 to about 1."""
    n, m = max(1, len(text)), max(1, len(w))
    symbols = sum(map(text.count, "#*$%&|<>"))
    repeated = sum(map(str.__eq__, w, w[1:]))
    upper = sum(map(str.isupper, w))
    return [min(1.0, 8 * symbols / n), min(1.0, 8 * text.count("!") / n), upper / m, repeated / m, text.count("|") / m, len(set(w)) / m, min(1.0, np.log1p(m) / 10), min(1.0, sum(map(text.count, "0123456789")) * 8 / n)]


def keys(w: list[str], cache: dict[str, int]) -> set[int]:
    """31-bit hashes of the distinct words, lower-case and without marks at their ends."""
    out = set()
    for x in set(w):
        k = cache.get(x)
        if k is None:
            if len(cache) >= CACHE:
                cache.clear()
            k = cache[x] = zlib.crc32(x.strip(EDGES).lower().encode()) & 0x7FFFFFFF
        out.add(k)
    return out


@dataclass
class Model:
    """Weights of a logistic model, its intercept and the share of good documents it was fitted on."""

    weights: dict[int, float]
    shape: np.ndarray
    intercept: float
    prior: float

    def logit(self, text: str | None, cache: dict[str, float]) -> float:
        text = text or ""
        w = text.split()
        total = self.intercept + float(np.dot(self.shape, shape(text, w)))
        out = set()
        for x in set(w):
            k = cache.get(x)
            if k is None:
                if len(cache) >= CACHE:
                    cache.clear()
                key = zlib.crc32(x.strip(EDGES).lower().encode()) & 0x7FFFFFFF
                k = cache[x] = key if key in self.weights else -1
            if k >= 0:
                out.add(k)
        return total + sum(map(self.weights.__getitem__, out))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], *, least: int = 10, clear: float = 6.0, penalty: float = 1e-4, rounds: int = 400) -> Model:
    """Fit on (word keys, shape, good) with Adam on all rows at once.

    Words count that at least ``least`` rows have, and whose shares of good and bad
    rows differ by ``clear`` standard errors; the others would only add noise.
    """
    y = np.array([r[2] for r in rows], float)
    if len(rows) == 0 or y.min() == y.max():
        prior = float(np.clip(y.mean() if len(rows) else 0.5, 1e-3, 1 - 1e-3))
        return Model({}, np.zeros(SHAPES), float(np.log(prior / (1 - prior))), prior)
    flat = np.concatenate([r[0] for r in rows]).astype(np.int64)
    names, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.full(len(names), -1)
    labels = np.repeat(y, [len(r[0]) for r in rows])
    n_good = y.sum()
    good = np.bincount(inverse, labels, len(names))
    both = counts / len(y)
    error = np.sqrt(both * (1 - both) * (1 / n_good + 1 / (len(y) - n_good))) + 1e-12
    apart = np.abs(good / n_good - (counts - good) / (len(y) - n_good)) / error
    common = np.flatnonzero((counts >= least) & (apart >= clear))
    place[common] = np.arange(len(common))
    col = place[inverse]
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    row, col = row[col >= 0], col[col >= 0]
    dense = np.array([r[1] for r in rows], float)
    w, v, b = np.zeros(len(common)), np.zeros(SHAPES), 0.0
    state = [np.zeros(len(common) + SHAPES + 1) for _ in range(2)]
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[col], len(rows)) + dense @ v + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
        grad = np.concatenate([np.bincount(col, error[row], len(common)) + penalty / 10 * w, dense.T @ error + penalty / 100 * v, [error.sum()]])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        step = 0.1 * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-8)
        w, v, b = w - step[: len(common)], v - step[len(common) : -1], b - step[-1]
    return Model(dict(zip(names[common].tolist(), w.tolist(), strict=True)), v, float(b), float(np.clip(y.mean(), 1e-3, 1 - 1e-3)))


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", toxic: str | None = "toxic", max_rows: int = 10_000) -> Model:
    """Fit on at most about ``max_rows`` labelled documents: those whose id's hash is low enough.

    Good is quality 1 and, where there is such a column, toxic 0. Of documents that
    share an id the one with the least text counts. Only hashed words and shapes of
    those documents reach the driver.
    """
    good = (F.col(quality) == 1) & (F.coalesce(F.col(toxic), F.lit(0)) == 0 if toxic else F.lit(True))
    known = labels.where(F.col(doc_id).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.min(good.cast("int")).alias("_good"))
    share = max_rows / max(1, known.count())
    lot = F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) / float(1 << 40)
    some = known.where(lot < share) if share < 1 else known  # about ``max_rows`` rows, so broadcast
    picked = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(some), "_id")
    picked = picked.groupBy("_id").agg(F.min("_text").alias("_text"), F.first("_good").alias("_good")).select("_text", "_good")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        cache: dict[str, int] = {}
        for batch in batches:
            ks, shapes = [], []
            for value in batch.column(0):
                t = value.as_py() or ""
                w = t.split()
                ks.append(np.array(sorted(keys(w, cache)), np.int32))
                shapes.append(shape(t, w))
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.list_(pa.int32())), pa.array(shapes, pa.list_(pa.float64())), batch.column(1)], ["keys", "shape", "good"])

    found = picked.mapInArrow(features, "keys array<int>, shape array<double>, good int").toArrow()
    ks = found.column("keys").combine_chunks()
    flat, ends = ks.flatten().to_numpy(), np.cumsum([0, *ks.value_lengths().to_pylist()])
    shapes = np.array(found.column("shape").to_pylist(), float).reshape(-1, SHAPES)
    return fit([(flat[ends[i] : ends[i + 1]], shapes[i], g) for i, g in enumerate(found.column("good").to_pylist())])


def evidence(docs: DataFrame, model: Model, text: str) -> Column:
    """Each document's log odds of being good, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        cache: dict[str, float] = {}
        for texts in batches:
            yield pd.Series([shared.value.logit(t, cache) for t in texts], dtype=float)

    return score(F.col(text))


def _concentration(groups: DataFrame, n: str, mean: Column, above: Column, of: Column, noise: float, parents: float) -> float:
    """How many documents the level above is worth to a group: noise over the spread that noise doesn't explain."""
    total, squares, spread, count = groups.agg(F.sum(n), F.sum(F.col(n) * F.col(n) / of), F.sum(F.col(n) * (mean - above) ** 2), F.count(F.lit(1))).first()
    if not total or count <= parents or total <= squares:
        return 1e12
    between = (spread - (count - parents) * noise) / (total - squares)
    return 1e12 if between <= 1e-12 else max(1e-3, noise / between)


def site_posteriors(scored: DataFrame, *, levels: tuple[str, ...], p: str) -> tuple[DataFrame, list[float]]:
    """Sums for every site of the last of ``levels`` and of those above it, and the shrinkage of each level.

    ``levels`` are columns from the host down; ``p`` is each document's probability.
    Columns _l1, _l2, ... name a site, _n1, _s1, _n2, ... are its documents and their
    sum at each level. The list has the prior, then each level's concentration. Of
    documents only grouped sums are made; a level's rows are its sites.
    """
    names = [f"_l{d}" for d in range(1, len(levels) + 1)]
    sums = stage(scored.groupBy(*[F.col(c).alias(x) for c, x in zip(levels, names, strict=True)]).agg(F.count(F.lit(1)).alias("_n"), F.sum(p).alias("_s"), F.sum(F.col(p) * F.col(p)).alias("_q")), "sites")
    out = sums.select(*names)
    for d in range(1, len(levels) + 1):
        of = sums.groupBy(*names[:d]).agg(*[F.sum(f"_{x}").alias(f"_{x}{d}") for x in "nsq"]).select(*[F.col(x).alias(f"_of_{x}") for x in names[:d]], f"_n{d}", f"_s{d}", f"_q{d}")
        same = F.col("_of__l1").eqNullSafe(F.col("_l1"))
        for x in names[1:d]:
            same = same & F.col(f"_of_{x}").eqNullSafe(F.col(x))
        out = out.join(of, same).drop(*[f"_of_{x}" for x in names[:d]])
    out = stage(out, "sites")
    top = out.select("_l1", "_n1", "_s1", "_q1").distinct()
    n, s, n_hosts, noise = top.agg(F.sum("_n1"), F.sum("_s1"), F.count(F.lit(1)), F.sum(F.col("_q1") - F.col("_s1") ** 2 / F.col("_n1"))).first()
    if not n:
        return out, [0.5, *[1e12] * len(levels)]
    prior = float(np.clip(s / n, 1e-6, 1 - 1e-6))
    noise = max(1e-9, noise / max(1, n - n_hosts))
    mean = lambda d: F.col(f"_s{d}") / F.col(f"_n{d}") if d else F.lit(prior)
    found, parents = [prior], 1
    for d in range(1, len(levels) + 1):
        sites = out.select(*names[:d], *[f"_{x}{k}" for k in range(1, d + 1) for x in "ns"]).distinct()
        found.append(_concentration(sites, f"_n{d}", mean(d), mean(d - 1), F.col(f"_n{d - 1}") if d > 1 else F.lit(float(n)), noise, parents))
        parents = sites.count() if d < len(levels) else 0
    return out, found


def url_levels(docs: DataFrame, url: str, *, paths: int = 2) -> tuple[DataFrame, tuple[str, ...]]:
    """``docs`` with the host of ``url`` (lower-case, without www.) and its first one to ``paths`` path prefixes; and the names of those columns, the host's first.

    A null or broken address is a site of its own; an address with a shorter path has
    its whole path at the deeper levels.
    """
    host = F.regexp_replace(F.lower(F.try_parse_url(F.col(url), F.lit("HOST"))), r"^www\.", "")
    parts = F.array_remove(F.split(F.coalesce(F.try_parse_url(F.col(url), F.lit("PATH")), F.lit("")), "/"), "")
    names, out = [], docs
    for k in range(paths + 1):
        name = free_name(out, f"_site{k}")
        out = out.withColumn(name, host if k == 0 else F.array_join(F.slice(parts, 1, k), "/"))
        names.append(name)
    return out, tuple(names)


def classify(
    docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", levels: tuple[str, ...] = ("source", "lang"), keep: tuple[str, ...] | None = None,
    threshold: float = 0.5, max_rows: int = 10_000, model: Model | None = None,
) -> DataFrame:
    """The ``keep`` columns (default: doc_id), then evidence, host_posterior, path_posterior, posterior (double) and kept.

    ``labels`` (doc_id, quality, toxic) train the model; the site posteriors come from
    all of ``docs``. ``levels`` name the host's column and those of the paths below it,
    from wide to narrow; ``url_levels`` makes them from addresses. The table of
    documents has no addresses, so there its source stands for the host and its
    language for the part of the host below it. host_posterior is that of the first
    level and path_posterior that of the last. ``kept`` is posterior >= threshold.

    Null text counts as empty, nulls in a level are sites of their own. Conflicting
    labels of a document count as the worse; without labels of both kinds the evidence
    is their share. Repeated rows each get their row and count in their site; an empty
    table gives an empty result. An output whose name a kept column has gets
    underscores at its end. The evidence is written once, beside what is kept.
    """
    keep = tuple(keep or (doc_id,))
    model = model or train(docs, labels, doc_id=doc_id, text=text, max_rows=max_rows)
    own = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)] + [F.col(c).alias(f"s{i}") for i, c in enumerate(levels)]
    rows = docs.select(*own, F.col(text).alias("t")).withColumn("z", evidence(docs, model, "t")).drop("t")
    rows = stage(rows, "evidence").withColumn("p", 1.0 / (1.0 + F.exp(-F.col("z"))))
    sites, (prior, *worth) = site_posteriors(rows, levels=tuple(f"s{i}" for i in range(len(levels))), p="p")
    same = F.col("s0").eqNullSafe(F.col("_l1"))
    for i in range(1, len(levels)):
        same = same & F.col(f"s{i}").eqNullSafe(F.col(f"_l{i + 1}"))
    rows = rows.join(sites, same)
    bound = lambda x: F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6))
    above = F.lit(prior)
    for d, k in enumerate(worth, 1):  # a document's own evidence is left out
        rows = rows.withColumn(f"post{d}", bound((F.col(f"_s{d}") - F.col("p") + k * above) / (F.col(f"_n{d}") - 1 + k)))
        above = F.col(f"post{d}")
    total = F.col("z") - float(np.log(prior / (1 - prior))) + F.log(above / (1.0 - above))
    rows = rows.withColumn("post", 1.0 / (1.0 + F.exp(-total)))
    out = {"evidence": F.col("z"), "host_posterior": F.col("post1"), "path_posterior": F.col(f"post{len(levels)}"), "posterior": F.col("post"), "kept": F.col("post") >= threshold}
    taken = docs.select(*keep)
    return rows.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[x.alias(free_name(taken, c)) for c, x in out.items()])


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with their columns as they are, whatever their names."""
    verdict = free_name(docs, "kept")
    return classify(docs, labels, keep=tuple(docs.columns), **options).where(F.col(verdict)).select(*docs.columns)
