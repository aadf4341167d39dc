"""Quotations against a plain version, and short, re-wrapped and partial ones."""

import collections
import random
import re

from catalume.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def normal(x):
    return re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").lower()


def units(x):
    """Texts to look for in other messages, with what each is worth."""
    return {u: len(u) for u in {normal(x), *map(normal, x.split("\n")), *re.split(r"(?<=[.!?]) ", normal(x))} if u}


def windows(x, shorter):
    w = [v for v in re.sub(r"[^\w]|_", " ", normal(x)).split(" ") if v]
    out = {}
    for k in range(1, 6) if shorter else [max(1, min(5, len(w)))]:
        for i in range(len(w) - k + 1):
            u = "\n" + " ".join(w[i : i + k])
            out[u] = len(u) - 1 if len(w) < 5 else len(w[i]) + 1
    return out


def plain(rows):
    """What link_quotations gives, message by message."""
    read = []
    for conv, turn, _, text in rows:
        lines = []
        for line in (text or "").split("\n"):
            mark = re.match(r"((?:[ \t]*>)+)[ \t]?", line)
            lines.append((mark[1].count(">") if mark else 0, line[mark.end() :] if mark else line))
        quoted = any(level for level, _ in lines)
        kept, passages, before, run = [], collections.defaultdict(list), None, 0
        for k, (level, said) in enumerate(lines):
            run += level != before
            before = level
            deeper = k + 1 < len(lines) and lines[k + 1][0] > level
            if quoted and deeper and re.search(quotes.ATTRIBUTION[4:], said, re.I):
                continue
            if level:
                passages[level, run].append(said)
            else:
                kept.append(said)
        own = re.sub(r"^\s+|\s+$", "", "\n".join(kept)) if quoted else text or ""
        read.append((conv, turn, own, {k: "\n".join(v) for k, v in passages.items()}))
    said, heard = collections.defaultdict(dict), {}
    for conv, turn, own, _ in read:
        if conv is None or turn is None:
            continue
        for u in units(own):
            said[u][conv] = min(turn, said[u].get(conv, turn))
        for u in windows(own, True):
            heard[u, conv] = min(turn, heard.get((u, conv), turn))
    out = []
    for conv, turn, own, passages in read:
        votes, here, away = collections.Counter(), set(), []
        for (level, run), text in passages.items() if conv is not None and turn is not None else ():
            found = [(said[u].get(conv), n) for u, n in units(text).items()] + [(heard.get((u, conv)), n) for u, n in windows(text, False).items()]
            for first, n in found:
                if first is not None and first < turn:
                    here.add((level, run))
                    votes[first] += n * (level == 1)
        for (level, run), text in passages.items():
            if conv is not None and turn is not None and (level, run) not in here:
                for u, n in units(text).items():
                    others = sorted((c, t) for c, t in said[u].items() if c != conv)
                    if others:
                        away.append((n, others[0], len(said[u]), (level, run)))
        best = max(((n, first) for first, n in votes.items() if n), default=(0, None))[1]
        link = max(((n, at, among) for n, at, among, _ in away), default=(0, (None, None), None))
        out.append((conv, turn, own, best, *link[1], link[2], len(passages), len(here) + len({k for *_, k in away})))
    return out


def test_generated_threads_equal_a_plain_version(spark):
    """Nested, repeated, short, partial and clashing quotes, with attributions, odd turns and nulls."""
    rng = random.Random(8)
    words = ["yes", "no", "the", "plan", "is", "late", "Why?", "we", "ship.", "it", "Then", "stop!", "ok", "go"]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for conv in [*range(12), None]:
        past = []
        for turn in sorted(rng.sample(range(-3, 10**14), 7)):
            text = "\n".join(sentence(rng.randint(1, 9)) for _ in range(rng.randint(1, 3)))
            if past and rng.random() < 0.8:
                old = rng.choice(past) if rng.random() < 0.8 else rng.choice(rows)[3] or ""
                lines = old.split("\n")
                if rng.random() < 0.3:
                    lines = lines[: rng.randint(1, len(lines))]
                text = rng.choice(["", "On Monday X wrote:\n"]) + "\n".join("> " + x for x in lines) + "\n" + text
            past.append(text)
            rows.append((conv, turn if rng.random() < 0.95 else None, "u", text if rng.random() < 0.97 else None))
    got = quotes.link_quotations(spark.createDataFrame(rows, SCHEMA)).collect()
    columns = ("conv_id", "turn", "text", "parent_turn", "linked_conv", "linked_turn", "linked_among", "n_quotes", "n_linked")
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got))) == sorted(map(str, plain(rows)))
    for conv in {r.conv_id for r in got}:
        own = [r for r in got if r.conv_id == conv and r.parent_turn is not None]
        at = {r.turn: r for r in got if r.conv_id == conv}
        assert all(r.reply_path.startswith(at[r.parent_turn].reply_path + "/") and r.depth == at[r.parent_turn].depth + 1 and r.root_turn == at[r.parent_turn].root_turn for r in own)


def test_paths_sort_as_turns_do(spark):
    turns = [-(1 << 63), -5, -1, 0, 7, 10**13, (1 << 63) - 1]
    rows = [(1, t, "u", f"text number {k}") for k, t in enumerate(turns)] + [(2, -5, "u", "alpha"), (2, 3, "a", "> alpha\nbeta"), (2, 10**15, "u", "> beta\nx")]
    got = quotes.link_quotations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r.turn for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.reply_path)] == turns
    assert [r.depth for r in sorted((r for r in got if r.conv_id == 2), key=lambda r: r.reply_path)] == [0, 1, 2]


def test_what_is_said_twice_counts_for_the_first(spark):
    rows = [(1, 0, "u", "a passage said twice"), (1, 3, "a", "a passage said twice"), (1, 4, "u", "> a passage said twice\nyes")]
    got = {r.turn: r.parent_turn for r in quotes.link_quotations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: None, 3: None, 4: 0}


def test_odd_rows_clashing_names_and_empty_tables(spark):
    rows = [(1, 0, "u", "x " * 200_000, "a", "b", "c"), (1, 1, "u", "> " + "x " * 200_000 + "\nno", "a", "b", "c"), (None, None, None, None, None, None, None), (1, 1, "u", ">", "a", "b", "c"), (1, 1, "u", ">", "a", "b", "c")]
    docs = spark.createDataFrame(rows, SCHEMA + ", level string, hash string, parent_turn string")
    assert quotes.link_quotations(docs).count() == 5 and quotes.link_quotations(docs.limit(0)).count() == 0


def test_short_rewrapped_and_partial_quotations(spark):
    one = "The plan has three parts.\nWe measure first what is slow,\nthen we change it and measure again."
    rows = [
        (1, 0, "u", "Yes, I agree."), (1, 1, "a", "> Yes, I agree.\nGood."), (1, 2, "u", "> Good.\nFine"),
        (2, 0, "u", one), (2, 1, "a", "Something else entirely was said here."), (2, 2, "u", "> We measure first\n> what is slow, then we change\n> it and measure again.\nSure"),
        (3, 0, "u", "It rains a lot today. The match is off because of it, they say. See you."), (3, 1, "a", "No news from me."), (3, 2, "u", "> the match is off because of it\nA pity"), (3, 3, "a", "> A pity\n> > off because\nIndeed"),
        (4, 0, "u", "> Yes, I agree.\nshort ones link other conversations, too"), (4, 1, "u", "> The match is off because of it,\n> they say.\nReally?"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: r.parent_turn for k, r in got.items()} == {(1, 0): None, (1, 1): 0, (1, 2): 1, (2, 0): None, (2, 1): None, (2, 2): 0, (3, 0): None, (3, 1): None, (3, 2): 0, (3, 3): 2, (4, 0): None, (4, 1): None}
    assert (got[1, 2].root_turn, got[1, 2].depth, got[3, 3].n_linked) == (0, 2, 2)
    assert (got[4, 0].linked_conv, got[4, 0].linked_turn, got[4, 0].linked_among) == (1, 0, 1) and (got[4, 1].linked_conv, got[4, 1].linked_turn) == (3, 0)
