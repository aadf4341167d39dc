"""Each operator against a brute-force version, and on null, empty, repeated and clashing rows."""

import collections
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from catalume.llm import attention, bpe, decontaminate, divergence, kdtree, lm_scoring, quality, quotes, separators, simhash, surrogates
from catalume.llm.queries import END, pattern, ranks

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, fp string, kept string, score string, shard string"
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "one two"), (4, "same words here again"), (4, "same words here again"), (5, "A" * 30_000), (6, "a b c " * 5_000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None if i == 2 else "en", None if i == 3 else "s", None, "x", "x", "x", "x", "x") for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_every_operator_takes_odd_and_empty_tables(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (5, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "same words here again"), (2, None), (3, "x")], "item_id long, text string")
    for rows in (odd, odd.limit(0)):
        n = rows.count()
        assert divergence.divergence_rules(rows).count() == n
        assert separators.count_documents(rows, ranks(), pattern(), separator=END).count() == n
        assert quality.classify(rows, labels).count() == n
        assert simhash.near_duplicates(rows).count() == n
        assert kdtree.kd_shards(rows, 4).count() == n
        assert surrogates.pseudonymise(rows, "k").count() == n
        assert decontaminate.contaminated(rows, items).count() == (2 if n else 0)
        assert decontaminate.drop_contaminated(rows, items).count() == (n - 2 if n else 0)
        assert lm_scoring.score_documents(rows, ranks(), pattern()).count() == n


def test_divergence_equals_sql_on_odd_rows(odd):
    con = duckdb.connect()
    con.register("documents", odd.select("doc_id", "text", "lang").toArrow())
    got = divergence.divergence_rules(odd).drop("class_distance", "word_distance").collect()
    want = con.sql(divergence.rules_sql()).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_languages_have_references_of_their_own(spark):
    """Clean texts in scripts and languages without a list are kept among many others; a text of another script is not."""
    rng = np.random.default_rng(6)
    text = lambda letters: " ".join("".join(rng.choice(list(letters), rng.integers(2, 9))) for _ in range(150))
    rows = [(k, text("abcdefghij"), "xx") for k in range(300)] + [(1000 + k, text("абвгдежзик"), "bg") for k in range(30)] + [(2000 + k, text("אבגדהוזחטי"), None) for k in range(30)]
    rows += [(5000, text("αβγδεζηθικ"), "bg"), (5001, text("あいうえおかきく"), None), (5002, text("אבגדהוזחטי"), "xx")]
    got = {r.doc_id: r.kept for r in divergence.divergence_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {i for i, kept in got.items() if not kept} == {5000, 5001, 5002}


def test_divergence_equals_sql_on_other_scripts(spark):
    texts = ["Ünïcode éàç Ελληνικά текст по русски и не на с что он " * 12, "漢字かな交じり文 한국어 " * 40, "हिन्दी العربية עברית \U00020000 " * 30, "plain words here for the test of it " * 20]
    rows = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate((t, lang) for t in texts for lang in ("ru", "en", "zz", None) for _ in range(6))], "doc_id long, text string, lang string")
    con = duckdb.connect()
    con.register("documents", rows.toArrow())
    got = divergence.divergence_rules(rows, min_reference=3).drop("class_distance", "word_distance").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.sql(divergence.rules_sql(min_reference=3)).fetchall()))


def test_separators_across_blocks(spark, docs):
    encoder = bpe.BytePairEncoder(bpe.read_ranks(ranks()), pattern())
    want = sorted(len(encoder.encode(r.text or "")) for r in docs.collect())
    for block in (2, 4096, 1 << 22):
        some = docs.limit(20) if block == 2 else docs
        got = sorted(r.n_tokens for r in separators.count_documents(some.where("n_chars < 400") if block == 2 else some, ranks(), pattern(), separator=END, block_bytes=block).collect())
        assert got == (sorted(len(encoder.encode(r.text)) for r in some.where("n_chars < 400").collect()) if block == 2 else want)


def test_separators_of_files_without_a_last_one(spark, tmp_path):
    for name, ids in {"a": [1, 2, END, END, 3], "b": [END], "c": [], "d": [7, 8]}.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    got = sorted((r.file[-1], r.ordinal, r.first_token, r.n_tokens) for r in separators.scan_separators(spark, str(tmp_path), separator=END, block_bytes=4).collect())
    assert got == [("a", 0, 0, 2), ("a", 1, 3, 0), ("a", 2, 4, 1), ("b", 0, 0, 0), ("d", 0, 0, 2)]


def brute_components(prints, ids):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(prints)):
        for y in range(x):
            if (prints[x] ^ prints[y]).bit_count() <= 3:
                parent[find(x)] = find(y)
    least = collections.defaultdict(list)
    for x, i in enumerate(ids):
        least[find(x)].append(i)
    return [min((i for i in least[find(x)] if i is not None), default=None) for x in range(len(prints))]


def test_simhash_equals_brute_force(spark, docs, monkeypatch):
    got = simhash.near_duplicates(docs).orderBy("doc_id").collect()
    prints = [int(r.fingerprint, 16) for r in got]
    assert prints == [simhash.fingerprint(r.text) for r in docs.orderBy("doc_id").collect()]
    assert [r.component_id for r in got] == brute_components(prints, [r.doc_id for r in got])
    assert simhash.fingerprint("Ab  c") == simhash.fingerprint("ab\tc") != simhash.fingerprint("ab c d") and simhash.fingerprint(" ") == 0


def plain_print(text):
    """The fingerprint by its definition, bit by bit."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower) if x]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_by_definition(spark, docs):
    odd = ["", None, "One", "one TWO", "É é E\u2003x y", "a b c a b c a b c", "\x0b\x0cx\ty\nz\rw"]
    rows = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").unionByName(docs.where("n_chars < 3000").select((F.col("doc_id") + 100).alias("doc_id"), "text").limit(60))
    text = {r.doc_id: r.text for r in rows.collect()}
    assert {r.doc_id: r.fingerprint for r in simhash.near_duplicates(rows).collect()} == {i: f"{plain_print(t):016x}" for i, t in text.items()}


@pytest.mark.parametrize("crowded", [1000, 2])
def test_links_lose_nothing(spark, crowded):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 12)
    prints = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(63, n, replace=False)) for b in base for n in (0, 1, 2, 3, 4) for _ in range(5)})
    want = {(min(x, y), max(x, y)) for i, x in enumerate(prints) for y in prints[:i] if (x ^ y).bit_count() <= 3}
    frame = spark.createDataFrame([(x,) for x in prints], "fp long")
    assert {(r.a, r.b) for r in simhash.links(frame, crowded=crowded).collect()} == want


def test_kd_shards_are_even_gapless_and_checked(docs):
    rows = kdtree.kd_shards(docs, 16).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r["size"] == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert set(size) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(size.values()) / 16, max(r["size"] for r in rows)
    assert all(abs(s - mean) <= 2 * largest for s in size.values())


def test_quotes(spark):
    first = "Hello this is the first message of all.\nIt has two long lines in it."
    rows = [(1, 0, "u", first), (1, 1, "a", "On Monday X wrote:\n> It has two long lines in it.\nI agree with that one very much."), (1, 2, "u", "> > It has two long lines in it.\n> I agree with that one very much.\nThanks!"), (2, 0, "u", "> Hello   THIS is the first message of all.\nelsewhere"), (1, 3, "u", None), (1, 3, "u", None), (None, 1, "u", "> nobody ever said such a thing")]
    got = quotes.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    at = {(r.conv_id, r.turn): r for r in got}
    assert len(got) == len(rows) and at[1, 0].text == first
    assert (at[1, 1].text, at[1, 1].parent_turn, at[1, 1].depth) == ("I agree with that one very much.", 0, 1)
    assert (at[1, 2].text, at[1, 2].parent_turn, at[1, 2].root_turn, at[1, 2].depth, at[1, 2].n_linked) == ("Thanks!", 1, 0, 2, 2)
    assert (at[2, 0].linked_conv, at[2, 0].linked_turn, at[2, 0].parent_turn, at[None, 1].n_linked) == (1, 0, None, 0)
    assert quotes.link_quotations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def brute_alignment(item, text):
    best = 0.0
    table = np.zeros((len(item) + 1, len(text) + 1))
    for i in range(1, len(item) + 1):
        for k in range(1, len(text) + 1):
            table[i, k] = max(0, table[i - 1, k - 1] + (2 if item[i - 1] == text[k - 1] else -1), table[i - 1, k] - 1, table[i, k - 1] - 1)
            best = max(best, table[i, k])
    return best


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        item, text = rng.integers(0, 5, rng.integers(1, 9)), rng.integers(0, 5, rng.integers(1, 25))
        assert decontaminate.smith_waterman(item, text)[0] == brute_alignment(item, text)


def test_edited_copies_are_found(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    words = items.orderBy(F.desc(F.length("text"))).first().text.split()
    edited = " ".join(w if k % 7 else "changed" for k, w in enumerate(words))
    filler = " ".join(f"filler{k}" for k in range(300))
    rows = [(1, f"{filler} {edited} {filler}"), (2, filler), (3, " ".join(words[: len(words) // 5]))] + [(100 + k, f"{filler} {' '.join(words)}") for k in range(300)]
    got = {r.doc_id: r.score for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert 0.5 <= got[1] < 1 and 2 not in got and 3 not in got and all(got[100 + k] == 1 for k in range(300))


def test_recall_on_planted_edits(spark):
    """Words changed, put in or left out at every third to tenth place; of those that a full alignment finds, nine in ten are found at least."""
    rng = np.random.default_rng(9)
    items = [[f"i{k}x{rng.integers(400)}" for _ in range(rng.integers(20, 60))] for k in range(12)]
    filler = lambda n: [f"f{x}" for x in rng.integers(0, 900, n)]
    rows, want = [], set()
    for k, item in enumerate(items):
        for every in range(3, 11):
            for kind in ("change", "put in", "leave out"):
                edited = []
                for at, w in enumerate(item, 1):
                    if at % every:
                        edited.append(w)
                    elif kind != "leave out":
                        edited += ["new"] if kind == "change" else ["new", w]
                text = filler(150) + edited + filler(150)
                vocabulary = {w: n for n, w in enumerate(dict.fromkeys(text + item))}
                score, _ = decontaminate.smith_waterman(*(np.array([vocabulary[w] for w in t]) for t in (item, text)))
                if score >= len(item):  # half of a whole copy's
                    want.add((len(rows), k))
                rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got <= want and len(want) > 250 and len(got) >= 0.9 * len(want)


def test_short_items_are_found_as_whole_texts(spark):
    docs = spark.createDataFrame([(1, "Yes, indeed!"), (2, "yes indeed it is"), (3, "yes"), (4, None), (5, "...")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "yes indeed"), (2, "Yes."), (3, ""), (4, "--")], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.score) for r in decontaminate.contaminated(docs, items).collect()} == {(1, 1, 1.0), (3, 2, 1.0)}


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known, unseen = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = quality.classify(docs, known).join(unseen, "doc_id").withColumn("good", F.expr("quality = 1 AND toxic = 0"))
    found = got.select("good", "kept", "quality").collect()
    share = lambda rows, kept: sum(r.kept == kept for r in rows) / len(rows)
    assert share([r for r in found if r.good], True) > 0.99
    assert share([r for r in found if r.quality == 0], False) > 0.95
    # a tenth of the toxic labels are on texts without any word that other toxic texts share
    assert share([r for r in found if not r.good], False) > 0.85


def test_sparse_sites_shrink(spark):
    rows = [("big", "a", 0.9)] * 400 + [("bad", "a", 0.1)] * 400 + [("new", "a", 0.1)] + [("mid", "a", 0.6)] * 200
    sites, k = quality.site_posteriors(spark.createDataFrame(rows, "source string, lang string, p double"), levels=("source", "lang"), p="p")
    mean = {r._l1: (r._s1 + k[1] * k[0]) / (r._n1 + k[1]) for r in sites.collect()}
    assert mean["bad"] < 0.12 and mean["big"] > 0.88 and abs(mean["new"] - 0.1) > abs(mean["bad"] - 0.1)


def test_model_probabilities_sum_to_one_and_gradients_hold():
    rng = np.random.default_rng(1)
    counts = rng.integers(6, 50, 300).astype(float)
    voc = attention.Vocabulary.of(counts, rng.random((200, 128)), np.arange(200))
    w = attention.start(voc)
    w["O"] *= 100
    scorer = attention.Scorer(w, voc)
    context = rng.integers(0, 299, 40)
    one_of = [np.flatnonzero(voc.kind == c)[0] for c in np.unique(voc.kind)]
    last = [scorer.score(np.append(context, i), np.array([41]), 299)[0] for i in one_of]
    assert np.exp(np.array(last) - scorer.score(context, np.array([40]), 299)[0]).sum() == pytest.approx(1, abs=1e-3)
    both = scorer.score(np.concatenate([context, context[:7]]), np.array([40, 47, 47]), 299)
    assert both[0] == pytest.approx(scorer.score(context, np.array([40]), 299)[0], rel=1e-5) and both[2] == 0
    large = {k: v * np.float32(300) for k, v in w.items()}  # weights that overflow without care, and vanish
    assert np.isfinite(attention.Scorer(large, voc).score(context, np.array([40]), 299)).all()
    assert attention.Scorer(large, voc).steep and not scorer.steep
    moved = {**w, "o": w["o"] + np.float32(500)}
    assert attention.Scorer(moved, voc).score(context, np.array([40]), 299)[0] == pytest.approx(scorer.score(context, np.array([40]), 299)[0], rel=1e-4)
    w = {k: v.astype(float) for k, v in w.items()}
    units, kinds = rng.integers(0, attention.UNITS, (3, 32)), rng.integers(-1, attention.CLASSES, (3, 16))
    units[0, :16] = attention.UNITS
    _, g = attention.gradients(w, units, kinds)
    for name in w:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        sides = []
        for by in (1e-4, -2e-4):
            w[name][at] += by
            sides.append(attention.gradients(w, units, kinds)[0])
        w[name][at] += 1e-4
        assert (sides[0] - sides[1]) / 2e-4 == pytest.approx(g[name][at], rel=1e-2, abs=1e-5)


def test_base_scores_equal_brute_force(docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "FREQUENT", 100)  # most words then take the join
    got = lm_scoring.score_documents(docs, ranks(), pattern()).collect()
    cut = lambda t: [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x] + [None]
    text = {r.doc_id: cut(r.text) for r in docs.collect()}
    counts = collections.Counter(w for i, t in text.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    n, v = sum(counts.values()), len(counts)
    for r in got:
        t = text[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1, len(t), sum(counts[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), abs=1e-6) and r.score < 0


@pytest.mark.parametrize("kind", ["string", "int", "long", "short"])
def test_item_ids_of_any_type_in_batches_with_and_without_finds(spark, kind):
    item = "the quick brown fox jumps over the lazy dog near a river bank"
    docs = spark.createDataFrame([(k, f"before {item} after" if k in (3, 17) else None if k == 5 else "nothing of the kind in here") for k in range(20)], "doc_id long, text string").repartition(2, "doc_id")
    items = spark.createDataFrame([(7, item), (8, None)], "item_id int, text string").withColumn("item_id", F.col("item_id").cast(kind))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        found = decontaminate.contaminated(docs, items)
        assert {(r.doc_id, str(r.item_id)) for r in found.collect()} == {(3, "7"), (17, "7")}
        assert dict(found.dtypes)["item_id"] == dict(items.dtypes)["item_id"]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
