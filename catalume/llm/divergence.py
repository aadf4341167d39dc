"""Quality rules: how far a document's histograms lie from its language's.

Each document gets two histograms, of character classes and of the commonest
words of its language. The reference of a language is the sum over all its
documents that pass the base rules, whatever the language; only languages with a list
of words have the test of words. A document is rejected if the Jensen-Shannon
distance (base 2, so from 0 to 1) of either histogram is too large and the
document is long enough for that histogram to mean anything. DataFrame functions
only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalume.llm.common import free_name, stage, words

# Frequent function words of each language.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "with"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "it": ["di", "e", "il", "la", "che", "in", "a", "per", "un", "del", "non", "è"],
    "nl": ["de", "van", "het", "een", "en", "in", "is", "dat", "op", "te", "zijn", "met"],
    "pl": ["w", "i", "na", "z", "do", "się", "nie", "jest", "że", "to", "o", "jak"],
    "pt": ["de", "a", "o", "que", "e", "do", "da", "em", "um", "para", "com", "não"],
    "ru": ["и", "в", "не", "на", "с", "что", "он", "по", "как", "это", "из", "к"],
    "sv": ["och", "i", "att", "det", "som", "en", "på", "är", "av", "för", "med", "till"],
}
#: Languages of the reference that are broadcast at most; more are joined by shuffling.
FEW_LANGUAGES = 10_000
#: What isn't in a class of characters; the last class is what no other has. Those from ``latin`` on have no ASCII characters.
CLASSES = {
    "lower": "[^a-z]+", "upper": "[^A-Z]+", "digit": "[^0-9]+", "space": r"[^\x20\x09-\x0D]+", "symbol": r"[^#*$%&|<>]+", "mark": r"[^.,;:!?'\"()-]+",
    "latin": r"[^\x{AA}\x{B5}\x{BA}\x{C0}-\x{24F}\x{1E00}-\x{1EFF}]+", "greek": r"[^\x{370}-\x{3FF}\x{1F00}-\x{1FFF}]+", "cyrillic": r"[^\x{400}-\x{52F}]+", "semitic": r"[^\x{590}-\x{8FF}]+",
    "indic": r"[^\x{900}-\x{109F}]+", "east asian": r"[^\x{1100}-\x{11FF}\x{2E80}-\x{D7FF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]+",
}
N_ASCII = 6
SYMBOLS = "#*$%&|<>"


def base_columns(docs: DataFrame, text: str, w: str) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; ``w`` names the array of words."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines, hashes, ranked = (free_name(docs, c) for c in ("_lines", "_hashes", "_ranked"))
    windows = F.transform(F.sequence(F.lit(0), F.col("n_words") - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    docs = docs.withColumn(w, words(F.col(text))).withColumn("n_words", F.size(w)).withColumn(
        lines, F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, "\t\x0b\f\r ", "")) > 0)
    )
    docs = docs.withColumn(hashes, F.when(F.col("n_words") >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    # only where a window repeats: its positions, by sorting windows beside their positions
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    docs = docs.withColumn(ranked, F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), pairs))

    def twin(x: Column, k: Column) -> Column:
        near = [F.coalesce(F.get(ranked, j)["h"] == x["h"], F.lit(False)) for j in (k - 1, k + 1)]
        return near[0] | near[1]

    starts = F.filter(ranked, twin)
    covered = F.size(F.array_distinct(F.flatten(F.transform(starts, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    return docs.select(
        "*",
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(F.col(ranked).isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
    ).drop(lines, hashes, ranked)


def _distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance of two arrays of counts; null if either is empty."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    share = lambda c: F.transform(c, lambda x: x / total(c))

    def terms(x: Column, y: Column) -> Column:
        one = lambda a, b: F.when(a > 0, a * F.log2(2.0 * a / (a + b))).otherwise(0.0)
        return one(x, y) + one(y, x)

    both = F.aggregate(F.zip_with(share(p), share(q), terms), F.lit(0.0), lambda s, x: s + x)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(F.lit(0.0), both / 2.0)))


def divergence_rules(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    keep: tuple[str, ...] = ("doc_id",),
    max_class_distance: float = 0.3,
    max_word_distance: float = 0.275,
    min_chars: int = 200,
    min_words: int = 100,
    min_reference: int = 20,
    common_words: dict[str, list[str]] = COMMON_WORDS,
) -> DataFrame:
    """One row per input row: the ``keep`` columns, the base counts and the verdict.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``
    (long), ``base_failed``, ``class_distance`` and ``word_distance`` (double; null
    where the document or the reference is too small), ``kept``. Null text counts
    as empty and fails the base rules. Every value of ``lang`` has its own reference,
    null that of the empty name; one that fewer than ``min_reference`` documents made
    rejects nothing. ``common_words`` lists the words of each language; others have no
    test of words. Repeated rows each get their row. An empty table gives an empty
    result. The reference has a row for each language; a few are broadcast.
    """
    n_common = max(map(len, common_words.values()), default=0)
    t = F.coalesce(F.col(text), F.lit(""))
    words_of = F.array().cast("array<string>")
    for k, v in common_words.items():
        words_of = F.when(F.col("_lang") == k, F.array(*map(F.lit, v))).otherwise(words_of)
    src = docs.select(*keep, t.alias("_text"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("_lang")).withColumn("_list", words_of)
    counted = base_columns(src, "_text", "_w")
    counted = counted.withColumn("_hits", F.filter("_w", lambda x: F.array_contains(F.col("_list"), x)))
    left = [F.length(F.regexp_replace("_text", p, "")).cast("double") for p in CLASSES.values()]
    ascii_only = F.octet_length("_text") == F.length("_text")
    by_class = [x if i < N_ASCII else F.when(ascii_only, 0.0).otherwise(x) for i, x in enumerate(left)]
    counted = counted.select(
        *keep, "_lang", F.col("n_words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.length("_text").cast("double").alias("_chars"),
        *[c.alias(f"_c{i}") for i, c in enumerate(by_class)],
        F.transform("_list", lambda x: F.size("_hits") - F.size(F.array_remove("_hits", x))).alias("_h"),
        F.size("_hits").cast("double").alias("_n_hits"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    classes = [F.col(f"_c{i}") for i in range(len(CLASSES))]
    hits = [F.coalesce(F.get("_h", F.lit(i)), F.lit(0)).cast("double") for i in range(n_common)]
    counted = counted.select(
        *keep, "_lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "_chars",
        F.array(*classes, F.col("_chars") - sum(classes[1:], classes[0])).alias("_c"),
        F.array(*hits, F.col("n_words") - F.col("_n_hits")).alias("_w"),
    )
    counted = stage(counted, "divergence")
    summed = lambda c, m: F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(m)])
    reference = counted.where(~F.col("base_failed")).groupBy("_lang").agg(F.count(F.lit(1)).alias("_n_ref"), summed("_c", len(CLASSES) + 1).alias("_rc"), summed("_w", n_common + 1).alias("_rw"))
    reference = stage(reference, "reference")
    both = counted.join(F.broadcast(reference) if reference.count() <= FEW_LANGUAGES else reference, "_lang", "left")
    enough = F.coalesce(F.col("_n_ref"), F.lit(0)) >= min_reference
    both = both.withColumn("class_distance", F.when(enough & (F.col("_chars") >= min_chars), _distance("_c", "_rc")))
    both = both.withColumn("word_distance", F.when(enough & F.col("_lang").isin(*common_words) & (F.col("n_words") >= min_words), _distance("_w", "_rw")))
    near = (F.coalesce(F.col("class_distance"), F.lit(0.0)) <= max_class_distance) & (F.coalesce(F.col("word_distance"), F.lit(0.0)) <= max_word_distance)
    return both.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", (~F.col("base_failed") & near).alias("kept"))


def rules_sql(max_class_distance: float = 0.3, max_word_distance: float = 0.275, min_chars: int = 200, min_words: int = 100, min_reference: int = 20) -> str:
    """The same rules as one DuckDB query over ``documents``."""
    lists = ", ".join(f"('{k}', [{', '.join(repr(w) for w in v)}])" for k, v in COMMON_WORDS.items())
    n, m = len(CLASSES), max(map(len, COMMON_WORDS.values()))
    split = r"list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

    def distance(kind: str, size: int) -> str:
        p = [f"{kind}{i}/n_{kind}" for i in range(size)]
        q = [f"r_{kind}{i}/rn_{kind}" for i in range(size)]
        term = lambda x, y: f"(CASE WHEN {x} > 0 THEN ({x}) * log2(2.0 * ({x}) / (({x}) + ({y}))) ELSE 0.0 END)"
        total = " + ".join(f"{term(x, y)} + {term(y, x)}" for x, y in zip(p, q, strict=True))
        return f"CASE WHEN n_{kind} > 0 AND rn_{kind} > 0 THEN sqrt(greatest(0.0, ({total}) / 2.0)) END"

    sums = lambda kind, size, pre="": " + ".join(f"{pre}{kind}{i}" for i in range(size))
    return f"""
WITH lists(l, ws) AS (VALUES {lists}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS l, coalesce(ws, []::VARCHAR[]) AS ws FROM documents LEFT JOIN lists ON lang = lists.l),
w AS (SELECT *, {split} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
grams AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i+1], w[i+2]) AS c FROM win),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM grams, (VALUES (0), (1), (2)) o(k) WHERE c > 1 GROUP BY rid),
f AS (SELECT w.rid, doc_id, l, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  length(t)::DOUBLE AS chars, {", ".join(f"length(regexp_replace(t, '{p.replace(chr(39), chr(39) * 2)}', '', 'g'))::DOUBLE AS c{i}" for i, p in enumerate(CLASSES.values()))},
  {", ".join(f"len(list_filter(w, lambda x: x = ws[{i + 1}]))::DOUBLE AS w{i}" for i in range(m))},
  len(list_filter(w, lambda x: NOT list_contains(ws, x)))::DOUBLE AS w{m}
  FROM w LEFT JOIN rep USING (rid)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, chars - ({sums("c", n)}) AS c{n} FROM f),
r AS (SELECT l, count(*) AS n_ref, {", ".join(f"sum(c{i}) AS r_c{i}" for i in range(n + 1))}, {", ".join(f"sum(w{i}) AS r_w{i}" for i in range(m + 1))} FROM g WHERE NOT base_failed GROUP BY l),
j AS (SELECT g.*, r.* EXCLUDE (l), {sums("c", n + 1)} AS n_c, {sums("c", n + 1, "r_")} AS rn_c, {sums("w", m + 1)} AS n_w, {sums("w", m + 1, "r_")} AS rn_w FROM g LEFT JOIN r USING (l)),
k AS (SELECT *, CASE WHEN coalesce(n_ref, 0) >= {min_reference} AND chars >= {min_chars} THEN {distance("c", n + 1)} END AS dc,
  CASE WHEN coalesce(n_ref, 0) >= {min_reference} AND l IN ({', '.join(map(repr, COMMON_WORDS))}) AND n_words >= {min_words} THEN {distance("w", m + 1)} END AS dw FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(dc, 0) <= {max_class_distance} AND coalesce(dw, 0) <= {max_word_distance} AS kept FROM k
"""
