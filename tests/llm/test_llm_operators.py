"""The dealt operators against brute force on small tables with nulls, empties, ties, repeats and extra columns."""

import collections
import hashlib
import itertools
import os
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sentinelweave.llm import decontamination, licenses, line_dedup, mixing, near_copies, quality, suffix_dedup, token_counts, topk, warc
from sentinelweave.llm.common import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, copy long"
ODD = [None, "", " \t\n", "a", "Ärger über Öl\n\nUnder the MIT License.", "x" * 5000, "A" * 300 + " " + "A" * 300]


def sentence(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "ein", "la", "nuée"]) if rng.random() < 0.3 else "".join(rng.choice("aeiounrstl") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    base = [sentence(rng, rng.randint(1, 120)) + ".\n" + sentence(rng, rng.randint(5, 60)) for _ in range(40)]
    texts = ODD + base
    for text in base[:15]:
        words = text.split(" ")
        for edits in (0, 1, 2, 8):
            changed = list(words)
            for _ in range(edits):
                changed[rng.randrange(len(words))] = "changed" + str(rng.randrange(100))
            texts.append(" ".join(changed))
    line = sentence(rng, 14)
    texts += [line + "\n" + sentence(rng, 30) + "\n" + line for _ in range(12)]
    out = [(i, t, "en", "src%d" % (i % 3) if i % 4 else None, None, 0.5, 7) for i, t in enumerate(texts)]
    rng.shuffle(out)
    return out + [(None, base[0], None, "src1", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def fold_words(text):
    return (text or "").encode().lower().split()


# Line deduplication


def lines_brute(rows):
    last = 2**63 - 1
    out, seen = collections.defaultdict(list), []
    for i, text in sorted({(last if r[0] is None else r[0], r[1]) for r in rows if r[1] is not None}):
        for j, line in enumerate(text.split("\n")):
            w = fold_words(line)
            if not w:
                continue
            own = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
            if any(100 * len(own & o) >= 80 * len(own | o) for o in seen):
                out[i].append(j)
            seen.append(own)
    return {(None if i == last else i): ",".join(map(str, v)) for i, v in out.items()}


def test_lines(docs, rows, nothing):
    got = {r.doc_id: r.removed_lines for r in line_dedup.line_report(docs).collect() if r.n_removed}
    assert got == lines_brute(rows)
    kept = {r.doc_id: r.text for r in line_dedup.without_repeats(docs).collect()}
    gone = lines_brute(rows)
    for i, text, *_ in rows:
        want = "\n".join(x for j, x in enumerate((text or "").split("\n")) if str(j) not in gone.get(i, "").split(","))
        if i not in gone:
            assert kept[i] == text
        elif want.strip():
            assert kept[i] == want
        else:
            assert i not in kept
    assert line_dedup.without_repeats(docs).columns == docs.columns
    assert line_dedup.line_report(nothing).count() == 0


def test_lines_prefix_rows_move_once(spark, docs):
    plans, stored = [], line_dedup.stored
    line_dedup.stored = lambda df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), stored(df, name))[1]
    try:
        line_dedup.repeated_lines(docs)
    finally:
        line_dedup.stored = stored
    assert dict(plans)["members"].count("MapInArrow") == 1


def test_lines_leave_no_table_behind_and_split_texts_outside_of_lambdas(spark, docs):
    # Nodes, members, ids and sets stayed on disk to the end, and every line of a text split the whole text anew.
    made, stored = [], line_dedup.stored
    line_dedup.stored = lambda df, name: (made.append((name, stored(df, name))), made[-1][1])[1]
    try:
        out = line_dedup.without_repeats(docs)
    finally:
        line_dedup.stored = stored
    folders = {table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:") for name, table in made if name in ("lines", "nodes", "members", "ids", "sets")}
    assert len(folders) == 5 and not any(os.path.exists(f) for f in folders)
    # Catalyst repeats the text for the filter; each of the two splits stands outside of the lambda over lines.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2


def test_sketches_differ_in_no_more_bits_than_sets_in_tokens():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)) for _ in range(60)]
    words = np.stack(line_dedup.parities(np.concatenate(sets), np.r_[0, np.cumsum([len(x) for x in sets])]), 1).view(np.uint64)
    apart = lambda a, b: sum(int(x ^ y).bit_count() for x, y in zip(a.tolist(), b.tolist()))
    assert all(apart(words[i], words[j]) <= len(np.setxor1d(sets[i], sets[j])) for i in range(60) for j in range(60))
    assert apart(words[0], words[0]) == 0 and line_dedup.parities(np.zeros(0, np.uint64), np.zeros(1, np.int64))[0].size == 0


# Web archive


def test_warc_round_trip(spark):
    long, bound = "ä" * 600, "b" * 1000
    pages = [(1, "http://a/", long, 1), (5, None, long, 2), (3, "http://c\r\nX: y", long, 3), (9, "u", bound, 4), (8, "u", bound, 5), (7, "v", "b" * 999, 6), (6, "v", "b" * 999, 7)]
    pages += [(2, "n", None, 8), (4, "e", "", 9), (10, "w", "x\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n", 10), (11, "w", "z" * 200_000, 11)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, n long")
    path = scratch_path(spark, "test-archives")
    got = {r.page_id: tuple(r)[1:] for r in warc.round_trip(df, path).collect()}
    assert len(got) == len(pages)
    for i, _, html, _ in pages:
        raw = (html or "").encode()
        same = max(p[0] for p in pages if (p[2] or "") == (html or ""))
        revisit = len(raw) >= 1000 and same != i
        assert got[i] == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", same if revisit else None)
    full = {r.page_id: bytes(r.payload) for r in warc.restore(warc.read_archives(spark, path)).collect()}
    assert full == {p[0]: (p[2] or "").encode() for p in pages}
    assert warc.round_trip(df.limit(0), scratch_path(spark, "test-archives")).count() == 0


# Token counts


def test_token_counts(docs, rows, nothing):
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    model = public.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    got = collections.Counter(tuple(r) for r in token_counts.token_counts(docs, model).collect())
    want = collections.Counter((r[0], len((r[1] or "").encode()), n := len(sp.encode(r[1] or "")), n > 4096) for r in rows)
    assert got == want
    assert token_counts.token_counts(nothing, model).count() == 0


def test_merges_equal_the_library():
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    model = public.path("piece_bpe_32k.model")
    sp, own = sentencepiece.SentencePieceProcessor(model_file=model), token_counts.loaded(model)
    rng = random.Random(4)
    parts = ["a", "b", "the", " ", "  ", "\n", "▁", "é", "中", "日本", "😀", "<s>", "\0", "ing", "====", "aaaa", "\t", "0", "ñ", "...", "<0x0A>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["a" * 3000, "=" * 999 + " x", "the" * 400]
    assert own.counts(texts) == [len(x) for x in sp.encode(texts)]


# Repeated byte strings


def test_suffix_order():
    rng = random.Random(8)
    for _ in range(200):
        text = bytes(rng.choice([0, 1, 97, 98, 98, 255]) for _ in range(rng.randint(1, 180)))
        order = suffix_dedup.suffix_order(np.frombuffer(text, np.uint8)).tolist()
        keys = [text[i : i + suffix_dedup.LENGTH] for i in order]
        assert sorted(order) == list(range(len(text))) and keys == sorted(keys)


def test_repeated_bytes(docs, rows, nothing):
    last = 2**63 - 1
    first = {}
    for i, text, *_ in rows:
        raw, i = (text or "").encode(), last if i is None else i
        for p in range(len(raw) - 49):
            first[raw[p : p + 50]] = min(i, first.get(raw[p : p + 50], last))
    want = collections.Counter()
    for i, text, *_ in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < (last if i is None else i):
                gone[p : p + 50] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want[i, len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in suffix_dedup.remove_repeats(docs).drop("kept").collect()) == want
    assert suffix_dedup.remove_repeats(nothing).count() == 0


# License scan


def test_license_base_places(docs, rows, nothing, spark):
    more = [(900, "UNDER the mit LICENSE, under the MIT license; Apache License, Version 2.0 (CC BY-NC)"), (901, "underthe mit license"), (902, None), (902, "cc-by-nc")]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.license_scan(df).collect())
    want = collections.Counter()
    for i, text in [(r[0], r[1]) for r in rows] + more:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        hits, labels = [], set()
        for label, phrase, _ in licenses.BASE:
            p = phrase.replace("@", "").split()
            at = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            hits += at
            labels |= {label} if at else set()
        want[i, len(words), len(hits), min(hits, default=None), max(hits, default=None), ",".join(sorted(labels))] += 1
    assert got == want
    assert licenses.license_scan(nothing).count() == 0


def wording(rng, parsed):
    """A text that a parsed expression of licenses.py matches, with random choices; look-arounds are left out."""
    out = ""
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "IN":
            kind, value = rng.choice(arg)
            out += chr(value if str(kind) == "LITERAL" else rng.randint(*value))
        elif op == "MAX_REPEAT":
            out += "".join(wording(rng, arg[2]) for _ in range(rng.randint(arg[0], arg[1])))
        elif op == "SUBPATTERN":
            out += wording(rng, arg[3])
        elif op == "BRANCH":
            out += wording(rng, rng.choice(arg[1]))
        else:
            assert op == "ASSERT", op
    return out


def test_license_rules_meet_the_prefilter(spark):
    rng = random.Random(5)
    rules = licenses.signatures()
    rows = [(n, wording(rng, re._parser.parse(r[4])).replace("@", "").upper().replace(" ", "\n- ")) for n, r in enumerate(rules) for _ in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").distinct()
    hit = licenses.detections(docs).filter("doc_id = rule").select("doc_id", "h").distinct()
    lost = docs.withColumn("h", F.xxhash64("text")).join(hit, ["doc_id", "h"], "left_anti").collect()
    assert not lost, [(rules[r.doc_id], r.text) for r in lost[:5]]


def test_license_texts_without_the_word(spark):
    texts = {
        "Released under the GPLv3.": "gpl-3", "Distributed under the Apache 2.0 terms": "apache-2", "Available under the BSD 3-Clause": "bsd-3-clause", "CC0 1.0": "cc0",
        "published under Zero-Clause BSD": "0bsd", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
        "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc", "Put under the table": "",
        "This is free and unencumbered software released into the public domain.": "unlicense",
    }
    rows = list(enumerate(texts))
    got = {r.doc_id: r.labels for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {t: got[i] for i, t in rows} == texts


def test_license_places_after_wide_characters(spark):
    texts = ["under the MIT License", "Apache License Version 2", "CC BY-NC"]
    rows = [(i * 10 + n, "\U0001F600 " * n + "a\u2028b " + t + " end") for i, t in enumerate(texts) for n in range(5)]
    got = {r.doc_id: (r.n_base, r.first_word, r.last_word) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (1, i % 10 + 1, i % 10 + 1) for i, _ in rows}


def test_license_suppression(spark):
    texts = [(1, "Released under the GNU Lesser General Public License version 3"), (2, "SPDX-License-Identifier: BSD-3-Clause"), (3, "the zlib license and the ISC license")]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: ("lgpl-3", 0.95), 2: ("bsd-3-clause", 1.0), 3: ("isc,zlib", 0.85)}


def test_seeds_meet_every_allowed_pattern():
    for n in range(1, 21):
        masks = decontamination.MASKS if n >= decontamination.SPAN else decontamination.short_masks(n, decontamination.SHARE)
        spare = n - -(-4 * n // 5)
        for gap in itertools.combinations(range(n), spare):
            assert any(all(kept == "0" or at + i not in gap for i, kept in enumerate(mask)) for mask in masks for at in range(n - len(mask) + 1)), (n, gap)


def test_leaks_of_short_items(spark):
    items = [(n, " ".join(f"w{n}x{i}" for i in range(n))) for n in range(1, 16)] + [(99, ""), (98, "What is the capital of France?")]
    docs, want = [], set()
    for n, text in items[:15]:
        spare = n - -(-4 * n // 5)
        for changed in range(spare + 2):
            for gap in itertools.islice(itertools.combinations(range(n), changed), 60):
                docs.append((len(docs), "before it " + " ".join("other" if i in gap else w for i, w in enumerate(text.split())) + " and after"))
                if changed <= spare and changed < n:
                    want.add((len(docs) - 1, n))
    docs.append((len(docs), "So: what is the CAPITAL of France"))
    want.add((len(docs) - 1, 98))
    df, held = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leaked(df, held).collect()} == want


# Exact top-k


def test_top_k(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)], 0) for i in range(300)]
    rows += [(i, [0.5, 0.25, 0.0, 0.0, 0.0], 1) for i in range(300, 340)]
    rows += [(400, None, 0), (401, [1.0, None, 1.0, 1.0, 1.0], 0), (402, [float("nan")] * 5, 0), (403, [float("inf")] * 5, 0), (None, [1.0] * 5, 0), (404, [], 0), (500, [3e9, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    monkeypatch.setattr(topk, "TILE", 32)
    monkeypatch.setattr(topk, "FAN_IN", 3)
    got = {tuple(r) for r in topk.top_k(df, df.filter("vec_id % 100 = 0")).collect()}
    data = {r.vec_id: r.embedding for r in df.collect() if r.vec_id is not None}
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in data.items() if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in whole if i % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:10]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert got == want
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


# Benchmark leaks


def test_leaks(spark, nothing):
    rng = random.Random(3)
    items = [(i, sentence(rng, 30)) for i in range(5)] + [(5, None), (6, ""), (7, "too short an item"), (8, sentence(rng, 9))]
    def swapped(text, *at):
        words = text.split()
        for i in at:
            words[i] = "swapped"
        return " ".join(words)
    clean = [(i, sentence(rng, 200)) for i in range(10)]
    bad = {20: (0, items[0][1]), 21: (1, swapped(items[1][1], 4, 11, 19)), 22: (2, items[2][1].upper().replace(" ", ", ")), 23: (8, items[8][1])}
    docs = clean + [(i, sentence(rng, 50) + " " + t + " " + sentence(rng, 50)) for i, (_, t) in bad.items()]
    docs += [(24, swapped(items[3][1], *range(0, 30, 3))), (25, " ".join(items[4][1].split()[:10])), (26, None), (None, items[0][1]), (20, docs[10][1])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item_id long, words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaked(df, bench).collect()}
    assert got == {(i, j) for i, (j, _) in bad.items()} | {(None, 0)}
    kept = decontamination.without_leaks(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in got}
    assert decontamination.leaked(nothing, bench).count() == 0
    assert decontamination.leaked(df, bench.limit(0)).count() == 0


# Quality


def test_quality_on_held_out_labels(spark, nothing):
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    got = quality.quality(docs).join(labels, "doc_id").select("keep", (F.col("quality") == 1).alias("good")).toPandas()
    assert (got.keep == got.good).mean() > 0.97
    assert got.keep[got.good].mean() > 0.99
    assert quality.quality(nothing).count() == 0


def test_quality_odd_rows(docs, rows):
    got = quality.quality(docs).collect()
    assert len(got) == len(rows)
    assert all(r.quality_score == 0 and not r.keep for r in got if r.doc_id in (0, 1, 2))
    assert quality.good_documents(docs).columns == docs.columns


# Mixing


def test_targets_and_copies(docs, rows, nothing):
    got = mixing.mix(docs).collect()
    sizes = collections.Counter()
    for _, text, _, source, *_ in rows:
        sizes[source] += len((text or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / share for s in order}
        over = {s for s in order if target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows)
    assert all(taken[s] == pytest.approx(target[s], rel=0.05) for s in order)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mixed_copies(docs).count() == sum(r.copies for r in got)
    assert mixing.mix(nothing).count() == 0


def test_two_margins(spark):
    cells = spark.createDataFrame([("a", "x", 100), ("a", "y", 50), ("b", "x", 30), ("b", "y", 200)], "source string, lang string, words long")
    goals = {"source": spark.createDataFrame([("a", 190.0), ("b", 190.0)], "source string, target double"), "lang": spark.createDataFrame([("x", 150.0), ("y", 230.0)], "lang string, target double")}
    got = mixing.balanced_rates(cells, goals).toPandas().assign(w=lambda d: d.words * d.rate)
    assert got.groupby("source").w.sum().to_dict() == pytest.approx({"a": 190, "b": 190})
    assert got.groupby("lang").w.sum().to_dict() == pytest.approx({"x": 150, "y": 230})
    rate = got.set_index(["source", "lang"]).rate
    assert rate["a", "x"] * rate["b", "y"] == pytest.approx(rate["a", "y"] * rate["b", "x"])


# Near copies


@pytest.mark.parametrize("words, hundredths", [(4, 85), (5, 80)])
def test_near_copies(docs, rows, nothing, words, hundredths, monkeypatch):
    monkeypatch.setattr(near_copies, "FEW", 2)
    sets = {}
    for i, text, *_ in rows:
        w = fold_words(text)
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    parent = {i: i for i in sets}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in itertools.combinations(sorted(i for i in sets if i is not None), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= hundredths * len(sets[a] | sets[b]):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_copies.near_copies(docs, words, hundredths).collect()}
    assert got == {i: (len(s), None if i is None else find(i)) for i, s in sets.items()}
    kept = near_copies.one_per_group(docs, words, hundredths)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in sets if i is None or find(i) == i}
    if words == 4:
        assert near_copies.near_copies(nothing).count() == 0


def test_stages_beside_clashing_columns(docs, spark):
    names = ["__d", "__h", "__lines", "__text", "__quality", "__size", "__s", "__z", "__n", "__m", "__own", "size", "copies"]
    clash = docs.withColumns({n: F.lit(n) for n in names})
    items = spark.createDataFrame([(1, "no document holds this benchmark item of a few words")], "item_id long, text string")
    for stage in (line_dedup.without_repeats, near_copies.one_per_group, mixing.mixed_copies, lambda x: decontamination.without_leaks(x, items)):
        plain = collections.Counter((r.doc_id, r.text) for r in stage(docs).collect())
        out = stage(clash)
        assert set(names) <= set(out.columns)
        rows = out.collect()
        assert collections.Counter((r.doc_id, r.text) for r in rows) == plain
        assert all(r[n] == n for r in rows for n in names)


def test_document_of_line_ends_only_goes(spark):
    line = "one line of words that stands in two documents and goes from the later"
    docs = spark.createDataFrame([(1, line), (2, "\n" + line + "\n"), (3, "\n")], "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.without_repeats(docs).collect()} == {1, 3}


def test_copies_of_equal_keys_are_the_same_on_reruns(spark):
    rows = [(i // 3, "word %d" % i, "src%d" % (i % 2)) for i in range(60)]
    frame = lambda n: spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(n)
    runs = [sorted((r.doc_id, r.text, r.copy) for r in mixing.mixed_copies(frame(n)).collect()) for n in (3, 5)]
    assert runs[0] == runs[1]


def test_quality_training_copies_a_block_at_a_time():
    x = np.random.default_rng(0).random((6000, 256), np.float32) * 0.1
    y = (np.arange(len(x)) % 5 > 0) * 0.9 + 0.05
    tracemalloc.start()
    weights = quality.train(x, y)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert weights.shape == (257,) and most < x.nbytes


def test_pipeline_lets_the_driver_collect_between_stages(spark, monkeypatch):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(i), lambda spark, docs, sf_dir: docs) for i in range(4)])
    before = full()
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert full() - before >= 3
