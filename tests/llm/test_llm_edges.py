"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terrascope.llm import (
    chat, components, decontaminate, jaccard, licenses, mixing, sharding, simhash, substring_dedup, suffix_dedup, toxicity,
)
from terrascope.llm.components import connected

SCHEMA = "doc_id long, text string, source string, key long, shard int, toxicity string, contamination string"
LONG = " ".join(f"word{i % 7001}x{i % 13}" for i in range(60_000))
COPY = " ".join(f"tok{i}" for i in range(60))
NEAR = " ".join(f"tok{i}" if i != 59 else "other" for i in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, None, "a", 1, 1, "x", "y"), (2, "", None, 1, 1, "x", "y"), (3, "  \n\t ", "a", 1, 1, "x", "y"),
        (4, COPY, "b", 1, 1, "x", "y"), (5, COPY, "b", 1, 1, "x", "y"), (6, NEAR, None, 1, 1, "x", "y"),
        (7, LONG, "a", 1, 1, None, None), (8, "one two", "c", None, None, None, None), (9, "One TWO", "c", 1, 1, "", ""),
        (10, "solo", "", 1, 1, "", ""), (10, "solo", "", 1, 1, "", ""), (None, "no id here at all", "b", 1, 1, "", ""),
        (11, "na" * 5000, "d", 1, 1, "", ""), (12, "Ünïcødé 東京 \U0001F600 " * 30, "d", 1, 1, "", ""),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, name="id"):
    return {r[name]: r for r in df.collect()}


def test_decontamination(spark, docs, nothing):
    items = spark.createDataFrame([
        ("a", " ".join(f"tok{i}" for i in range(20, 32))), ("b", "ONE two"), ("b", "one"), (None, "solo"), ("c", None),
        ("d", "..."), ("e", "never there")], "item_id string, text string")
    rows = decontaminate.find_contamination(docs, items).collect()
    found = {r.doc_id: r.contamination for r in rows}
    assert len(rows) == 14 and rows[0].asDict().keys() == {*docs.columns}
    assert (found[1].n_words, found[1].n_hit, found[1].items) == (0, 0, [])
    assert found[4].n_hit == 12 and found[4].items == ["a"] and [tuple(s) for s in found[4].spans] == [(20, 31)]
    assert found[8].items == ["b"] == found[9].items and found[9].n_hit == 2
    assert found[10].n_hit == 1 and found[10].items == []
    split = decontaminate.find_contamination(docs, items, block_bytes=10).collect()
    assert {r.doc_id: r.contamination for r in split} == found
    assert decontaminate.find_contamination(nothing, items).count() == 0
    assert decontaminate.find_contamination(docs, items.limit(0)).filter("contamination.n_hit > 0").count() == 0
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns and kept.filter("doc_id = 4 OR doc_id = 10").count() == 0


def test_wu_manber_finds_what_plain_search_finds():
    import random
    rng = random.Random(5)
    for size in (1, 2, 3, 6):
        strings = {tuple(rng.randint(1, 4) for _ in range(size)): {n} for n in range(9)}
        text = [rng.randint(0, 4) for _ in range(400)]
        found = sorted((i, min(items)) for i, items in decontaminate.Searcher(strings, 4).find(text))
        assert found == sorted((i, min(strings[t])) for i in range(len(text) - size + 1)
                               if (t := tuple(text[i:i + size])) in strings)


def test_reply_trees(spark):
    schema = "conv long, msg long, parent long, role string, text string, score double"
    tree = spark.createDataFrame([
        (1, 1, None, "user", "q ### </turn> \\0", 0.0), (1, 2, 1, "assistant", "good", 5.0), (1, 3, 1, "assistant", "bad", 1.0),
        (1, 4, 2, "us:er", None, 0.0), (1, 5, 4, "assistant", "end </turn>\n####", 1.0), (1, 6, 99, None, "orphan", 0.0),
        (None, 1, None, "user", "x", None)], schema)
    rows = {(r.conv, r["rank"]): r for r in chat.format_trees(tree).select(
        "*", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    best = rows[1, 1]
    assert [tuple(t) for t in best.turns] == [
        ("user", "q ### </turn> \\0"), ("assistant", "good"), ("us:er", ""), ("assistant", "end </turn>\n####")]
    assert (best.score, best.loss, best.n_turns) == (6.0, "goodend </turn>\n####", 4)
    assert rows[1, 2].loss == "bad" and [tuple(t) for t in rows[1, 3].turns] == [("", "orphan")]
    assert rows[None, 1].loss == "" and len(rows) == 4
    assert chat.format_trees(tree, branches=1).count() == 2
    assert chat.format_trees(tree.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.format_trees(tree.unionByName(tree))
    circle = spark.createDataFrame([(1, 1, 2, "a", "a", 0.0), (1, 2, 1, "a", "a", 0.0)], schema)
    with pytest.raises(ValueError):
        chat.format_trees(circle)
    deep = spark.createDataFrame([(1, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(70)], schema)
    got = chat.format_trees(deep).select(chat.read_turns(F.col("formatted")).alias("t")).first().t
    assert [t.text for t in got] == [str(i) for i in range(70)]


def test_mixing(spark, docs, nothing):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == 14 and {r.doc_id for r in rows if r.size == 0} == {1, 2, 3}
    sources = sorted({r.source for r in rows if r.source is not None}) + [None]
    size = {s: sum(r.size for r in rows if r.source == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    total, targets, free = 1.5 * sum(size.values()), {}, set(sources)
    while free:
        level = (total - sum(targets.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        if not over:
            targets |= {s: level * weight[s] for s in free}
            break
        targets |= {s: 2.0 * size[s] for s in over}
        free -= over
    for s in sources:
        mine = [r for r in rows if r.source == s]
        assert all(math.isclose(r.target, targets[s]) and r.taken <= 2 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - targets[s]) <= max(r.size for r in mine) + 1e-9
    taken = Counter({r.doc_id: r.taken for r in rows})
    assert Counter({r.doc_id: r.taken for r in mixing.mixed(docs.repartition(5)).collect()}) == taken
    assert mixing.mixed(nothing).count() == 0
    mix = mixing.mix(docs)
    assert mix.columns == docs.columns and mix.filter("doc_id = 4").count() == taken[4] // 60
    assert mixing.mix(nothing).count() == 0


def test_budgets_nest(spark):
    points = spark.range(500).select(
        F.lit("s").alias("source"), mixing.point(F.col("id")).alias("point"), (F.col("id") % 7 + 1).alias("size"))
    low = None
    for budget in (100.0, 400.0, 1200.0):
        below = mixing.thresholds(points, spark.createDataFrame([("s", budget)], "source string, budget double")).first().below
        got = points.filter(F.col("point") < below).agg(F.sum("size")).first()[0]
        assert abs(got - budget) <= 7 and (low is None or below > low)
        low = below


def test_toxicity(spark, docs, nothing):
    bad = [(100 + i, f"plain talk {i} you 1d1ot and mor0n", 1) for i in range(12)]
    good = [(1000 + i, f"plain talk {i} a nice day", 0) for i in range(200)] + [
        (300 + i, f"the idiot box {i} is on", 0) for i in range(5)]
    texts = spark.createDataFrame([(a, b) for a, b, _ in bad + good], "doc_id long, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in bad + good] + [(1, None)], "doc_id long, toxic int")
    model = toxicity.fit(texts, labels)
    assert any(p == "idiot box" for p in model.exceptions)
    probe = spark.createDataFrame([
        (1, "IDIOT"), (2, "іdіоt"), (3, "1diot!"), (4, ""), (5, None), (6, "a nice day"), (7, "the idiot box"),
        (8, LONG)], "doc_id long, text string")
    got = by_id(toxicity.score_toxicity(probe, model), "doc_id")
    assert [got[i].toxicity.predicted for i in range(1, 9)] == [1, 1, 1, 0, 0, 0, 0, 0]
    scored = toxicity.score_toxicity(docs, model)
    assert sorted(scored.columns) == sorted(docs.columns) and scored.count() == 14
    assert toxicity.remove_toxic(docs, model).columns == docs.columns
    assert toxicity.score_toxicity(nothing, model).count() == 0
    empty = toxicity.fit(texts, labels.limit(0))
    assert {r.toxicity.score for r in toxicity.score_toxicity(docs, empty).collect()} == {0.0}


def brute_bytes(texts, window):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + window] for b in data for i in range(len(b) - window + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i:i + window]] > 1:
                gone[i:i + window] = b"\1" * window
        out.append(bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def test_suffix_dedup(spark, docs, nothing, monkeypatch):
    rows = docs.collect()
    expected = Counter(zip([r.doc_id for r in rows], brute_bytes([r.text for r in rows], 30), strict=True))
    got = suffix_dedup.remove_repeats(docs, 30, 8)
    assert Counter((r.id, bytes(r.kept_bytes)) for r in got.collect()) == expected
    assert suffix_dedup.remove_repeats(nothing).count() == 0
    # a sign with more regions than a shard takes: its strings are merged across shards
    monkeypatch.setattr(suffix_dedup, "RIVALS", 2)
    middle = " ".join(f"m{i}" for i in range(12))
    many = [(i, f"{'abcdefgh'[i % 8] * (i // 8 + 3)} {middle} {'ijklmnop'[i % 8] * (i // 4 + 3)}") for i in range(64)]
    df = spark.createDataFrame(many, "doc_id long, text string")
    got = {r.id: bytes(r.kept_bytes) for r in suffix_dedup.remove_repeats(df, 30, 8).collect()}
    assert [got[i] for i, _ in many] == brute_bytes([t for _, t in many], 30)


def test_suffix_array_and_prefixes():
    import numpy as np
    text = b"banana bandana banana" * 3 + b"\0\0\0"
    order, _ = suffix_dedup.suffix_array(np.frombuffer(text, np.uint8), 10)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    prefixes = suffix_dedup.common_prefixes(text, order, 10**6, np.ones(len(text), bool))
    for k in range(1, len(text)):
        a, b = text[order[k - 1]:], text[order[k]:]
        assert prefixes[k] == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))


def brute_words(rows, window):
    """(id, kept) of (id, text) rows; equal rows are one document."""
    seen, out = {}, {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        words = (text or "").split()
        gone = set()
        for i in range(len(words) - window + 1):
            if seen.setdefault(tuple(words[i:i + window]), (doc, i)) != (doc, i):
                gone.update(range(i, i + window))
        out[doc, text] = " ".join(w for i, w in enumerate(words) if i not in gone)
    return Counter((d, out[d, t]) for d, t in rows)


def test_substring_dedup(spark, docs, nothing):
    loop = spark.createDataFrame([(20, "a b c " * 40), (21, "x y z " + "a b c " * 9), (22, COPY + " tail")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(loop)
    rows = [(r.doc_id, r.text) for r in both.collect()]
    for window, base in ((20, 5), (6, 5), (8, 8), (9, 2)):
        got = substring_dedup.remove_repeats(both, window, base)
        assert Counter((r.id, r.kept_text) for r in got.collect()) == brute_words(rows, window)
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_simhash(spark, docs, nothing):
    rows = simhash.fingerprint_documents(docs).collect()
    assert len(rows) == 14
    found = {r.id: r for r in rows}
    assert found[1].fingerprint == found[2].fingerprint == "0" * 16 and found[1].n_chars == 0
    assert found[4].fingerprint == found[5].fingerprint
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert found[12].edited_sha256 == hashlib.sha256(
        simhash.edited_text(text[12], text[None]).encode()).hexdigest()  # the last is followed by the first, the null id
    assert simhash.fingerprint_documents(nothing).count() == 0
    one = simhash.fingerprint_documents(docs.filter("doc_id = 4")).first()
    assert one.near_next == 1.0
    near = {r.fingerprint: r.n_near for r in simhash.near_counts(
        simhash.fingerprint_documents(docs), simhash.fingerprint_documents(docs)).collect()}
    bits = [int(r.fingerprint, 16) for r in rows]
    assert near == {f"{b:016x}": sum((b ^ o).bit_count() <= 3 for o in bits) for b in bits}


def shingles(text, n=5):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_classes(rows, percent):
    sets = [shingles(t) for _, t in rows]
    least = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]) and least[i] != least[j]:
                    least[i] = least[j] = min(least[i], least[j])
                    changed = True
    groups = {}
    for i, root in enumerate(least):
        groups.setdefault(root, []).append(rows[i][0])
    return Counter((rows[i][0], len(sets[i]), min((g for g in groups[r] if g is not None), default=None))
                   for i, r in enumerate(least))


def test_jaccard(spark, docs, nothing):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = jaccard.similar_classes(docs)
    assert Counter((r.id, r.n_shingles, r.component_id) for r in got.collect()) == brute_classes(rows, 80)
    assert jaccard.similar_classes(nothing).count() == 0
    kept = jaccard.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 7, 8, 10, None, 11, 12])


def test_jaccard_in_blocks(spark, monkeypatch):
    import random
    rng = random.Random(3)
    base = [[f"{g}w{i}" for i in range(60)] for g in range(3)]
    rows = []
    for i in range(160):
        words = list(base[i % 3])
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = f"r{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_classes(rows, 80)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 7)
    monkeypatch.setattr(jaccard, "LIST_SETS", 12)
    got = jaccard.similar_classes(df)
    assert Counter((r.id, r.n_shingles, r.component_id) for r in got.collect()) == expected


@pytest.mark.parametrize("block", [2, 500_000])
def test_components(spark, monkeypatch, block):
    monkeypatch.setattr(components, "BLOCK_LINKS", block)
    links = spark.createDataFrame([(1, 2), (3, 2), (7, 8), (9, 7), (5, 5), (3, 12), (20, 12)], "a long, b long")
    got = {r.node: r.root for r in connected(links, "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 12: 1, 20: 1, 7: 7, 8: 7, 9: 7}
    assert connected(links.limit(0), "a", "b").count() == 0


def test_licenses(spark, docs, nothing):
    said = [
        (1, "Text.\nreleased under the\nMIT license.\nMore."), (2, "Licensed under CC BY-SA 4.0."), (3, "Licensed under CC BY-SA 3.0."),
        (4, "A driving license for everyone."), (5, licenses.TEMPLATES["BSD-3-Clause"][1].replace(". ", ".\n")), (6, None),
        (7, "Licensed under CC BY 4.0.\nLicensed under CC BY-NC-ND 4.0."), (8, LONG + " Released under the MIT License. " + LONG)]
    df = spark.createDataFrame(said, "doc_id long, text string")
    got = {r[0]: r[1] for r in licenses.scan_licenses(df).select("doc_id", licenses.license_names()).collect()}
    assert got == {1: ["MIT"], 2: ["CC-BY-SA-4.0"], 3: [], 4: [], 5: ["BSD-3-Clause"], 6: [],
                   7: ["CC-BY-4.0", "CC-BY-NC-ND-4.0"], 8: ["MIT"]}
    assert licenses.scan_licenses(docs).count() == 14 and licenses.scan_licenses(nothing).count() == 0


def test_sharding(spark, docs, nothing, tmp_path):
    rows = sharding.shard_records(docs, map_path=f"file://{tmp_path}/map").collect()
    assert len(rows) == 14 and {r.size for r in rows if r.doc_id in (1, 2)} == {1}
    for shard in {r.shard for r in rows}:
        places = sorted(r.place for r in rows if r.shard == shard)
        assert places == list(range(len(places)))
    assert sharding.shard_records(nothing).count() == 0
    kept = sharding.sharded(docs)
    assert kept.count() == 14 and set(kept.columns) == {*docs.columns, "virtual_slot"}
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    sized = sharding.sized_records(many)
    by_slot = sharding.slot_bytes(sized)
    first = sharding.balanced_map(by_slot)
    sharding.write_map(first, f"file://{tmp_path}/versions", 1)
    second = sharding.rebalanced_map(sharding.read_map(spark, f"file://{tmp_path}/versions"), by_slot, 9)
    sharding.write_map(second, f"file://{tmp_path}/versions", 2)
    newest = sharding.read_map(spark, f"file://{tmp_path}/versions")
    load = {r.shard: r.b for r in by_slot.join(newest, "virtual_slot").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    assert set(load) == set(range(9)) and max(load.values()) < 1.05 * min(load.values())
    old = {r.virtual_slot: r.shard for r in sharding.read_map(spark, f"file://{tmp_path}/versions", 1).collect()}
    moved = sum(old[r.virtual_slot] != r.shard for r in newest.collect())
    assert 0 < moved < len(old) / 5


MIT_TEXT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.
"""
BSD_TEXT = """Copyright (c) 2019, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of {} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def named(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = licenses.scan_licenses(df).orderBy("doc_id").select("licenses.found").collect()
    return [[f.license for f in r.found] for r in rows]


def test_license_in_paragraphs(spark):
    bsd, google = BSD_TEXT.format("the copyright holder"), BSD_TEXT.format("Example Inc.")
    texts = [
        MIT_TEXT, bsd, google, " ".join(bsd.split()), MIT_TEXT.replace("\n", "\r\n"),
        "Licensed under CC BY 4.0.\n\n" + MIT_TEXT, LONG[:9000] + "\n" + MIT_TEXT, "A licensed word. " * 3000 + "\n\n" + MIT_TEXT]
    assert named(spark, texts) == [
        ["MIT"], ["BSD-3-Clause"], ["BSD-3-Clause"], ["BSD-3-Clause"], ["MIT"], ["CC-BY-4.0", "MIT"],
        ["MIT"], ["MIT"]]
    assert named(spark, ["Licensed under the Apache License, Version\n3. Anything"]) == [[]]


def test_several_licenses_in_a_block(spark):
    texts = [
        "Licensed under the MIT License. Licensed under CC BY 4.0.",
        "Licensed under the MIT License and the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0, or (at your option) the MIT license.",
        "Licensed under the MIT License, the Apache License, Version 2.0 and CC BY 4.0.",
        "Licensed under the MIT and the Apache License, Version 2.0.",
        "SPDX-License-Identifier: MIT OR Apache-2.0",
        "Licensed under the MIT License. The Apache License, Version 2.0 is longer.",
        "Licensed under the MIT No Attribution License.",
        MIT_TEXT + "\n" + BSD_TEXT.format("Somebody"),
        "Licensed under CC BY 4.0. Some words. " * 400,
        LONG[:3000] + " Licensed under CC BY 4.0. " + LONG[:1500] + " Released under the MIT License. " + LONG[:3000]]
    assert named(spark, texts) == [
        ["MIT", "CC-BY-4.0"], ["MIT", "Apache-2.0"], ["Apache-2.0", "MIT"], ["MIT", "Apache-2.0", "CC-BY-4.0"],
        ["MIT", "Apache-2.0"], ["MIT", "Apache-2.0"], ["MIT"], [], ["MIT", "BSD-3-Clause"], ["CC-BY-4.0"] * 400,
        ["CC-BY-4.0", "MIT"]]


def test_jaccard_of_sets_far_apart_in_size(spark):
    rows = []
    for g in range(6):
        words = [f"{g}w{i}" for i in range(204)]
        rows += [(3 * g, " ".join(words[:68])), (3 * g + 1, " ".join(words)), (3 * g + 2, " ".join(words[:60]))]
    rows += [(100, " ".join(f"9w{i}" for i in range(15))), (101, " ".join(f"9w{i}" for i in range(100)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (10, 30, 80):
        got = jaccard.similar_classes(df, percent=percent)
        assert Counter((r.id, r.n_shingles, r.component_id) for r in got.collect()) == brute_classes(rows, percent)


def test_sharding_by_a_stored_map(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    some = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    more = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    first = {r.doc_id: r.shard for r in sharding.shard_records(some, map_path=path).collect()}
    grown = {r.doc_id: r.shard for r in sharding.shard_records(more, map_path=path).collect()}
    assert len(grown) == 3000 and all(grown[i] == s for i, s in first.items())
    assert {r.doc_id: r.shard for r in sharding.sharded(more, map_path=path).collect()} == grown
    assert sharding.read_map(spark, path).count() == 4096 and sharding.stored_versions(spark, path) == [1]
    nine = {r.doc_id: r.shard for r in sharding.shard_records(more, 9, map_path=path).collect()}
    assert sharding.stored_versions(spark, path) == [1, 2] and set(nine.values()) == set(range(9))
    assert sum(nine[i] != s for i, s in grown.items()) < 1000
    again = {r.doc_id: r.shard for r in sharding.shard_records(more, map_path=path, version=1).collect()}
    assert again == grown and sharding.stored_versions(spark, path) == [1, 2]
