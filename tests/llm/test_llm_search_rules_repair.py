"""Lexical search, quality rules and conversation repair against brute force."""

import collections
import functools
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sentinelweave.llm import conversation_repair, lexical_search, quality_rules

DOC = "doc_id long, text string, score double, rank int, item_id string, term string, n long, kept string"
LONG = "zeta alpha " * 130_000


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "Öl", "ein", "la", "nuée", "x1"]) if rng.random() < 0.4 else "".join(rng.choice("aeiounrst") for _ in range(rng.randint(2, 4))) for _ in range(n))


def frame(spark, rows, schema=DOC):
    width = len(schema.split(","))
    return spark.createDataFrame([(*r, *([None] * (width - len(r)))) for r in rows], schema).repartition(3)


# Lexical search


def search_brute(docs, items, k=50):
    terms = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs = sum(1 for _, c in held if c)
    words = sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    wanted = collections.defaultdict(set)
    for i, text in items:
        wanted[i] |= set(terms(text))
    out = []
    for item, asked in wanted.items():
        found = []
        for i, c in held:
            n = sum(c.values())
            m = 100 - 50 + (50 * n * n_docs) // words if words else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("leaf, sample, pairs", [(4, 40, 60), (64, 32_768, 500_000)])
def test_search(spark, monkeypatch, leaf, sample, pairs):
    rng = random.Random(leaf)
    monkeypatch.setattr(lexical_search, "LEAF", leaf)
    docs = [(i, prose(rng, rng.randint(1, 120))) for i in range(300)]
    docs += [(1000 + i, docs[i][1]) for i in range(40)] + docs[:7] + [(None, docs[0][1]), (900, None), (901, ""), (902, " .!"), (903, LONG), (904, "\U0001f600 the\x7fof"), (-5, "OF the")]
    items = [(i, prose(rng, rng.randint(1, 30))) for i in range(12)] + [(3, "alpha THE"), (None, "zeta"), (50, None), (51, "nowhere"), (52, ""), (53, "\U0001f600"), (1, items_text := "of"), (1, items_text)]
    got = lexical_search.ranked(frame(spark, docs), frame(spark, items, "item_id long, text string, doc_id string"), sample=sample, pairs=pairs)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == search_brute(docs, items)


def test_search_of_nothing(spark):
    docs, items = frame(spark, [(1, "the")]), frame(spark, [(1, "the")], "item_id long, text string")
    assert lexical_search.ranked(docs.limit(0), items).count() == 0
    assert lexical_search.ranked(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in lexical_search.ranked(docs, items).collect()] == search_brute([(1, "the")], [(1, "the")])


def test_bounds_hold(spark):
    """No row of a subtree scores above the subtree's bound."""
    import numpy as np

    rng = np.random.default_rng(5)
    rows, width = 500, 40
    dense = np.where(rng.random((rows, width)) < 0.2, rng.integers(1, 10**6, (rows, width)), 0)
    dense[3] = dense[4] = dense[5]
    row, column = np.nonzero(dense)
    w = rng.integers(1, 12_000, width)
    inner = w[column] * dense[row, column]
    tree = lexical_search.Tree(np.searchsorted(row, np.arange(rows + 1)), column, inner / np.sqrt(w[column]), inner, width)
    for _ in range(30):
        query = np.flatnonzero(rng.random(width) < 0.3)
        asked = np.zeros(width, np.int64)
        asked[query] = 1
        bounds = tree.bounds(query, np.sqrt(w[query].astype(float)))
        for node in range(len(tree.low)):
            exact = (dense[tree.order[tree.low[node] : tree.high[node]]] * w * asked).sum(1)
            assert (tree.scores(node, asked) == exact).all() and exact.max() <= bounds[node]


# Quality rules


def rules_brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) for j in range(3) if windows[tuple(words[i : i + 3])] > 1}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def quality_rows(rng):
    docs, labels = [], []
    for i in range(400):
        text = prose(rng, rng.randint(20, 150)).replace(" ", "\n", 3)
        if i % 2:
            text = " ".join(w.upper() + rng.choice(["!!", "###", " |"]) for w in text.split())
        docs.append((i, text))
        if i < 300:
            labels.append((i, 1 - i % 2))
    return docs, labels


def test_quality_rules(spark):
    rng = random.Random(3)
    docs, labels = quality_rows(rng)
    line = prose(rng, 9)
    docs += [(500, None), (501, ""), (502, "\n \n"), (503, LONG), (504, "\n".join([line] * 3 + [line + " ", " ", " "])), (505, "a b a b a b c"), (506, "\U0001f600 <|> é\n\U0001f600 <|> é"), (None, docs[0][1]), (0, docs[0][1]), (507, "aaa aaa aaa")]
    labels += [(None, 1), (999, 0), (500, None), (5, 7), (7, 0), (503, 1)]
    out = quality_rules.quality_rules(frame(spark, docs), frame(spark, labels, "doc_id long, quality int, toxic int, text string")).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(((r.doc_id, *[r[n] for n in names]) for r in out), key=str) == sorted(((i, *rules_brute(t)) for i, t in docs), key=str)
    assert not any(r.kept and r.base_failed for r in out)
    judged = [r for r in out if r.doc_id is not None and 300 <= r.doc_id < 400 and not r.base_failed]
    assert len(judged) > 50 and sum(r.kept == (r.doc_id % 2 == 0) for r in judged) >= 0.97 * len(judged)
    again = quality_rules.quality_rules(frame(spark, docs[::-1]).repartition(7), frame(spark, labels[::-1], "doc_id long, quality int")).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_quality_rules_without_labels(spark):
    docs = frame(spark, [(1, "a " * 20 + " ".join(f"w{i}" for i in range(90))), (2, "short")])
    nothing = frame(spark, [(1, 1)], "doc_id long, quality int").limit(0)
    assert {r.doc_id: r.kept for r in quality_rules.quality_rules(docs, nothing).collect()} == {1: True, 2: False}
    assert quality_rules.quality_rules(docs.limit(0), nothing).count() == 0


def test_quality_rules_on_held_out_labels(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    learn = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    got = quality_rules.quality_rules(docs, labels.filter(learn)).filter("not base_failed").join(labels.filter(~learn), "doc_id")
    good, kept_good, bad, kept_bad = got.agg(F.sum("quality"), F.sum(F.col("quality") * F.col("kept").cast("int")), F.sum(1 - F.col("quality")), F.sum((1 - F.col("quality")) * F.col("kept").cast("int"))).first()
    assert kept_good >= 0.99 * good and kept_bad <= 0.1 * bad


# Conversation repair


def repair_brute(rows):
    """Results by conversation: a plain search over (turn, state) for the least cost, then the least letters."""
    out, text_of = {}, lambda x: " " if x is None else str(x)
    conversations = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        conversations[conv]
        kind = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        role, text = text_of(role), text_of(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        conversations[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    for conv, turns in conversations.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2][:64], hashlib.sha256(t[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in turns:
            body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))

        best = {}
        for i in range(len(turns), -1, -1):
            base = {}
            for state in ("", "s", "u", "a"):
                ways = []
                if i == len(turns):
                    if state in ("", "a"):
                        ways.append((0, "", ()))
                else:
                    _, role, text = turns[i]
                    ways.append((4 + best[i + 1, state][0], "D" + best[i + 1, state][1], best[i + 1, state][2]))
                    if faults[i] not in ("blank", "duplicate"):
                        more = 3 if faults[i] == "truncated" else 0
                        for letter, cost, name in (("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")):
                            if (name[:1] == "s" and state == "") or name[:1] == follow[state]:
                                c, letters, rest = best[i + 1, name[:1]]
                                ways.append((cost + more + c, letter + letters, (f"{name}:{text}", rest)))
                base[state] = ways
            for _ in range(3):
                for state in ("", "s", "u", "a"):
                    ways = list(base[state])
                    if (i, follow[state]) in best:
                        c, letters, rest = best[i, follow[state]]
                        ways.append((3 + c, "I" + letters, (("user:" if follow[state] == "u" else "assistant:"), rest)))
                    if ways:
                        best[i, state] = min(ways, key=lambda w: (w[0], w[1].encode()))
        cost, audit, chain = best[0, ""]
        lines = []
        while chain:
            lines.append(chain[0])
            chain = chain[1]
        known = [t[0] for t in turns if t[0] is not None]
        pairs = [a[1][:1] + "/" + b[1][:1] for a, b in zip(turns, turns[1:])]
        out[conv] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(p not in ("s/u", "u/a", "a/u") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def talk(rng, conv, n):
    texts = ["Yes.", "No", "", " \n", "Why?\t", "Ünd ... so", "ok!", "x" * 70 + ".", "x" * 70 + "!"]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "use"]
    out = []
    for turn in range(n):
        role = "user" if turn % 2 == 0 else "assistant"
        if rng.random() < 0.25:
            role = rng.choice(roles)
        text = rng.choice(texts) if rng.random() < 0.3 else f"Turn {turn} says {rng.randrange(99)}" + rng.choice([".", "!", "", "?"])
        out.append((conv, None if rng.random() < 0.03 else turn + (rng.random() < 0.05), role, None if rng.random() < 0.03 else text))
    return out


@pytest.mark.parametrize("block", [7, 4096])
def test_repair(spark, block):
    rng = random.Random(block)
    rows = [r for conv in range(60) for r in talk(rng, conv, rng.randint(1, 14))]
    rows += talk(rng, None, 40) + talk(rng, 777, 300) + [(888, 5, "user", "Same.")] * 90 + [(999, None, None, None), (1000, 0, "system", "Only."), (1001, 1, "user", "y" * 1_200_000 + "."), (1001, 2, "assistant", "Fine.")]
    rows += rows[:20]
    schema = "conv_id long, turn long, role string, text string, pos long, edits string, fault int, p int, key string"
    got = conversation_repair.repaired(frame(spark, rows, schema), block)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = {r.conv_id: tuple(r)[1:] for r in got.collect()}
    want = repair_brute(rows)
    assert len(found) == len(want)
    for conv in want:
        assert found[conv] == want[conv], conv


def test_repair_of_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversation_repair.repaired(frame(spark, [(1, 1, "user", "x")], schema).limit(0)).count() == 0
    dropped = next(i for i in range(999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert [tuple(r) for r in conversation_repair.repaired(frame(spark, [(dropped, 0, "user", "Hi.")], schema)).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
