"""Personal data replaced by keyed surrogates of the same type and format.

Entities are found in each text and folded to a canonical form. Every distinct
entity of the corpus draws a surrogate with a keyed hash: digits for digits, letters
for letters of the same script and case, names for names of the same gender and
script. A name is one person's wherever it stands: with any title, and without one
later in a text. Draws that meet another entity's surrogate or an entity that occurs
in the corpus are drawn again, so different entities stay different; the same entity
gets the same surrogate everywhere. First draws depend on the key and the entity
alone, so other texts change a surrogate only where they bring such a collision: one
latin name in two hundred where there are a million of them.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalume.llm.common import free_name, release, stage

# Titles with the gender they tell; a name follows.
TITLES = {"Mr": "m", "Herr": "m", "Señor": "m", "Monsieur": "m", "Господин": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Señora": "f", "Madame": "f", "Госпожа": "f", "Dr": "n", "Prof": "n"}
# Parts that surrogate names are made of, by script and gender; n is for surnames and unknown gender.
NAME_PARTS = {
    ("latin", "m"): (["Al", "Ber", "Con", "Dan", "Ed", "Fer", "Gil", "Har", "Jor", "Leo", "Mar", "Nor", "Os", "Rob", "Tor", "Wil"], ["bert", "dric", "lan", "man", "mund", "nard", "ric", "ton", "ven", "vin", "win", "zan"]),
    ("latin", "f"): (["Al", "Bel", "Cor", "Del", "El", "Fio", "Gra", "Is", "Jo", "Lil", "Mar", "Nor", "Ol", "Ros", "Sel", "Vi"], ["ana", "ella", "elda", "ena", "essa", "etta", "ia", "ina", "isa", "ona", "ora", "wen"]),
    ("latin", "n"): (["Ash", "Bram", "Cald", "Dun", "Elm", "Fair", "Gran", "Hol", "Kel", "Lang", "Mer", "North", "Pen", "Rad", "Stan", "Thorn", "West", "Wood"], ["berg", "bury", "croft", "dale", "ford", "ham", "ley", "low", "mont", "stead", "ton", "well", "wick", "worth"]),
    ("cyrillic", "m"): (["Вла", "Ро", "Ста", "Миро", "Яро", "Бори", "Глеб", "Свято"], ["слав", "мир", "дар", "влад", "мил"]),
    ("cyrillic", "f"): (["Вла", "Ра", "Ста", "Миро", "Яро", "Люд", "Свет", "Зла"], ["слава", "мира", "дана", "мила", "лина"]),
    ("cyrillic", "n"): (["Бел", "Вер", "Гор", "Дуб", "Зар", "Кор", "Лес", "Мор", "Пол", "Сев"], ["енко", "ский", "овский", "инец", "ович", "ченко"]),
}
#: Syllables that stand between the parts of a surrogate name: a consonant and a vowel each.
MIDDLES = {
    "latin": [c + v for c in "bdfghklmnprstvwz" for v in "aeiou"],
    "cyrillic": [c + v for c in "бвгдзклмнпрстфхш" for v in "аеиоуя"],
}
#: Syllables in every name's first draw, whatever else is in the corpus: over thirty million names for each script and gender.
SYLLABLES = 3
#: Draws of one format before surrogates grow longer.
DRAWS = 12
#: Letters to draw from, by script: first and last, lower-case where there is case.
SCRIPTS = {"latin": ("a", "z"), "cyrillic": ("а", "я"), "greek": ("α", "ω"), "hebrew": ("א", "ת"), "arabic": ("ف", "ي"), "hiragana": ("か", "ん"), "katakana": ("カ", "ン"), "hangul": ("가", "힣"), "han": ("一", "龥")}
#: Where a script's letters lie.
RANGES = (("Ͱ", "Ͽ", "greek"), ("Ѐ", "ԯ", "cyrillic"), ("\u0590", "\u05ff", "hebrew"), ("\u0600", "\u06ff", "arabic"), ("\u3040", "ゟ", "hiragana"), ("゠", "ヿ", "katakana"), ("㐀", "鿿", "han"), ("가", "힣", "hangul"))

_name = r"[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))+"
# every alternative begins where a run of its characters begins and doesn't step back into it, so the time is linear in the text
ENTITY = re.compile(
    r"(?<![\w.+%-])[.+%-]*+(?P<email>[\w+%][\w.+%-]*+(?<=[\w+%])@(?:[\w-]++\.(?=[\w-]))++[^\W\d_]{2,}+)"
    r"|(?:(?i:token|password|passwd|secret|api[_-]?key|access[_-]?key)[\"']?[ \t]*[=:][ \t]*[\"']?)(?P<secret>[A-Za-z0-9_+/=-]{8,}+)"
    r"|(?P<key>\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}+)\b)"
    r"|(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ip>(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9]))"
    r"|(?P<phone>(?<![\w+])\+[0-9]{1,3}[ .-]?\([0-9]{1,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![\w+])\+[0-9]{1,3}(?:[ -]?[0-9]{2,4}){2,4}(?![0-9]|\.[0-9])|(?<![\w+])\([0-9]{3}\)[ ]?[0-9]{3}[-.][0-9]{4}(?![0-9])|(?<![\w.+-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<card>(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9]))"
    rf"|\b(?P<title>{'|'.join(sorted(TITLES, key=len, reverse=True))})\.?[ ](?P<name>{_name}(?:[ ]{_name})?)"
)
_WORD = re.compile(rf"(?<!\w){_name}")
#: Texts without any of this hold no entity; Spark checks it before Python sees a text. Secrets but passwords have a digit.
HINT = "(?=[0-9@pP" + "".join(sorted({t[0] for t in TITLES})) + r"])(?:[0-9@]|[pP](?i:assw)|(?:" + "|".join(TITLES) + r")\.? )"
DIGITS = {"phone", "ssn", "card", "ip"}


def script(word: str) -> str:
    """The script of the first letter that isn't Latin; latin if there is none."""
    for c in word:
        if c > "ɏ":
            for a, z, name in RANGES:
                if a <= c <= z:
                    return name
    return "latin"


def _luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def _rest97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _is_secret(word: str, value: str) -> bool:
    """Whether what follows a word such as token may be one: it has a digit, or it is a password and not just a word in prose."""
    return any(c.isdigit() for c in value) or (word.lower().startswith("passw") and not value.isalpha())


def entities(text: str | None) -> list[tuple[int, int, str, str, str]]:
    """(start, end, type, canonical form, gender) of every entity, in order and without overlaps; gender is m, f or empty.

    Card numbers and IBANs must have right check digits. Names stand after a title;
    once a text has named someone, the name counts without a title, too.
    """
    text = text or ""
    out, named = [], {}
    for m in ENTITY.finditer(text):
        kind = m.lastgroup
        if kind != "name":
            raw, (a, b) = m[kind], m.span(kind)
            digits = re.sub(r"[^0-9]", "", raw) if kind in DIGITS - {"ip"} else ""
            if (kind == "card" and not _luhn(digits)) or (kind == "secret" and not _is_secret(m[0], raw)) or (kind == "iban" and _rest97(raw.replace(" ", "")) != 1):
                continue
            form = raw.lower() if kind == "email" else digits or (raw.replace(" ", "") if kind == "iban" else raw)
            out.append((a, b, "secret" if kind == "key" else kind, form, ""))
            continue
        parts, at = m["name"].split(" "), m.start("name")
        if not parts[0][0].isupper():
            continue
        parts = parts if len(parts) == 2 and parts[1][0].isupper() else parts[:1]
        for k, part in enumerate(parts):
            gender = TITLES[m["title"]].strip("n") if len(parts) == 2 and k == 0 else ""
            out.append((at, at + len(part), f"name-{script(part)}", part.casefold(), gender))
            named.setdefault(part.casefold(), at)
            at += len(part) + 1
    if named:
        taken, more, k = out, [], 0
        for m in _WORD.finditer(text):
            a, b = m.span()
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            form = m[0].casefold()
            if named.get(form, a) < a and m[0][0].isupper() and not (k < len(taken) and taken[k][0] < b):
                more.append((a, b, f"name-{script(m[0])}", form, ""))
        out = sorted(taken + more)
    return out


def _stream(secret: bytes, *parts: object) -> Iterator[int]:
    """Keyed bytes without end."""
    block = 0
    while True:
        yield from hmac.new(secret, "\x1f".join(map(str, (*parts, block))).encode(), hashlib.sha256).digest()
        block += 1


def _alike(text: str, draw: Iterator[int]) -> str:
    """Digits for digits, letters of the same case and script for letters; the rest stays."""
    out = []
    for c in text:
        if c.isdigit():
            out.append(str(next(draw) % 10))
        elif c.isalpha():
            first, last = map(ord, SCRIPTS[script(c)])
            new = chr(first + (next(draw) * 65536 + next(draw) * 256 + next(draw)) % (last - first + 1))
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def _private(ip: str) -> int:
    """How many leading numbers tell that an address is private or local; 0 for the others."""
    a, b = map(int, ip.split(".")[:2])
    return 1 if a in (10, 127) else 2 if (a, b) in ((192, 168), (169, 254)) or (a == 172 and 16 <= b < 32) else 0


def surrogate(kind: str, form: str, gender: str, attempt: int, secret: bytes) -> str:
    """The ``attempt``-th draw for an entity, in canonical form."""
    draw = _stream(secret, kind, form, attempt)
    longer = max(0, attempt - DRAWS)
    if kind == "email":
        local, _, domain = form.rpartition("@")
        top = domain.rpartition(".")[2]
        label = "".join("abcdefghijklmnopqrstuvwxyz"[next(d) % 26] for d in [_stream(secret, "domain", domain)] for _ in range(6))
        return f"{_alike(local, draw).lower()}{'x' * longer}@{label}.example.{top if top in ('com', 'net', 'org') else 'org'}"
    if kind == "ip":
        kept = form.split(".")[: _private(form)] if attempt < DRAWS or not _private(form) else ["10"]
        while True:
            new = ".".join([*kept, *[str(next(draw)) for _ in range(4 - len(kept))]])
            first = int(new.split(".")[0])
            if kept or (0 < first < 224 and not _private(new)):
                return new
    if kind == "card":
        body = form[0] + _alike(form[1:-1], draw) + "0" * longer
        return next(body + last for last in "0123456789" if _luhn(body + last))
    if kind == "secret":
        fixed = next((p for p in ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-") if form.startswith(p)), "")
        if all(c in "0123456789abcdef" for c in form):
            return str(next(draw) % 10) + "".join("0123456789abcdef"[next(draw) % 16] for _ in range(len(form) - 1 + longer))
        return fixed + _alike(form[len(fixed) :], draw) + "x" * longer
    if kind == "iban":
        body = _alike(form[4:], draw) + "0" * longer
        return f"{form[:2]}{98 - _rest97(form[:2] + '00' + body):02d}{body}"
    if kind in DIGITS:
        keep = 1 if kind == "phone" else 0  # the zone of a country code
        return form[:keep] + _alike(form[keep:], draw) + "0" * longer
    letters = kind.split("-")[1]
    if letters not in MIDDLES:
        return _alike(form, draw) + _alike(form[-1:] * longer, draw)
    heads, tails = NAME_PARTS[letters, gender or "n"]
    between = [MIDDLES[letters][next(draw) % len(MIDDLES[letters])] for _ in range(SYLLABLES + attempt // 4)]
    return "".join([heads[next(draw) % len(heads)], *between, tails[next(draw) % len(tails)]]).casefold()


def rendered(raw: str, kind: str, new: str) -> str:
    """A surrogate in the format of the mention that it replaces."""
    if kind in DIGITS - {"ip"} or kind == "iban":
        left = iter(new)
        out = "".join(next(left, "") if c.isalnum() else c for c in raw)
        return out + "".join(left)
    if "-" in kind:
        return new.upper() if raw.isupper() and len(raw) > 1 else "-".join(p[:1].upper() + p[1:] for p in new.split("-"))
    return new


def replace(text: str, table: dict[tuple[str, str], str]) -> str:
    out, at = [], 0
    for a, b, kind, form, _ in entities(text):
        out += [text[at:a], rendered(text[a:b], kind, table[kind, form])]
        at = b
    return "".join([*out, text[at:]])


FOUND = "array<struct<kind:string,form:string,n:bigint,m:bigint,f:bigint>>"


def counted(text: str | None) -> list[dict]:
    """The distinct entities of a text, with the numbers of their mentions, of male and of female ones."""
    out: dict[tuple[str, str], dict] = {}
    for _, _, kind, form, gender in entities(text):
        row = out.setdefault((kind, form), {"kind": kind, "form": form, "n": 0, "m": 0, "f": 0})
        row["n"] += 1
        if gender:
            row[gender] += 1
    return list(out.values())


def assign(found: DataFrame, secret: bytes, most: int = 60) -> DataFrame:
    """(kind, form, new) for the entities (kind, form, m, f): no two of a kind share ``new``, and none is itself an entity.

    A name has the gender that most of its mentions tell (m and f count them), and none if as many tell the other.
    """

    @F.pandas_udf("string")
    def draw(kind: pd.Series, form: pd.Series, gender: pd.Series, attempt: pd.Series) -> pd.Series:
        release()
        return pd.Series([surrogate(k, f, g, a, secret) for k, f, g, a in zip(kind, form, gender, attempt, strict=True)], dtype=object)

    # names of all scripts share one space, so that a name is never two people
    space = F.split("kind", "-").getItem(0)
    votes = found.groupBy("kind", "form").agg(F.sum("m").alias("m"), F.sum("f").alias("f"))
    gender = F.when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").otherwise("")
    known = stage(votes.select("kind", "form", gender.alias("gender"), space.alias("space")), "entities")
    originals = known.select("space", F.col("form").alias("new")).distinct()
    left, done = known.withColumn("attempt", F.lit(0)), None
    for attempt in range(most):
        drawn = stage(left.withColumn("new", draw("kind", "form", "gender", "attempt")), "drawn")
        first = drawn.groupBy("space", "new").agg(F.min(F.struct("kind", "form")).alias("who"))
        won = first.join(originals, ["space", "new"], "left_anti")
        won = won.join(done.select("space", "new"), ["space", "new"], "left_anti") if done is not None else won
        won = won.select("space", "new", "who.kind", "who.form")
        done = stage(won if done is None else done.unionByName(won), "surrogates")
        left = drawn.drop("new").join(done.select("kind", "form"), ["kind", "form"], "left_anti").withColumn("attempt", F.lit(attempt + 1))
        left = stage(left, "again")
        if left.isEmpty():
            return done.select("kind", "form", "new")
    raise ValueError(f"no free surrogates after {most} draws")


def pseudonymise(docs: DataFrame, secret: str, *, text: str = "text", n_chars: str | None = None, count: str = "n_entities") -> DataFrame:
    """``docs`` with every entity in ``text`` replaced, and the number of replacements in ``count``.

    All other columns are returned as they are, but for one named ``count``, which is
    replaced (``n_chars``, if named, is set to the new length where a text changes).
    Null and empty texts stay as they are; rows are neither dropped nor merged, and
    repeated rows get equal replacements. An empty table gives an empty result. Texts
    without entities are passed on without a shuffle; only texts with entities move.
    ``secret`` keys the draws and must not be empty.
    """
    if not secret:
        raise ValueError("surrogates need a key")
    key, mentions, news = (free_name(docs, c) for c in ("_row", "_mentions", "_news"))
    out = [*[c for c in docs.columns if c != count], count]
    docs = docs.drop(count)

    @F.pandas_udf(FOUND)
    def find(texts: pd.Series) -> pd.Series:
        release()
        return texts.map(counted)

    @F.pandas_udf("string")
    def put(texts: pd.Series, tables: pd.Series) -> pd.Series:
        release()
        return pd.Series([replace(t, {(x["kind"], x["form"]): x["new"] for x in table}) for t, table in zip(texts, tables, strict=True)], dtype=object)

    may = F.coalesce(F.col(text).rlike(HINT), F.lit(False))
    hinted = stage(docs.where(may).withColumn(mentions, find(text)).withColumn(key, F.monotonically_increasing_id()), "hinted")
    none = F.lit(0).cast("long").alias(count)
    clean = docs.where(~may).select("*", none).unionByName(hinted.where(F.size(mentions) == 0).drop(mentions, key).select("*", none))
    told = hinted.where(F.size(mentions) > 0)
    each = told.select(key, F.inline(mentions))
    table = assign(each, secret.encode())
    by_row = each.join(table, ["kind", "form"]).groupBy(key).agg(F.collect_list(F.struct("kind", "form", "new")).alias(news))
    changed = told.join(by_row, key).withColumn(text, put(text, news)).withColumn(count, F.aggregate(mentions, F.lit(0).cast("long"), lambda total, x: total + x["n"]))
    if n_chars:
        changed = changed.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
    return clean.select(*out).unionByName(changed.select(*out))
