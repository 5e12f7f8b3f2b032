"""The corpus operators against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from markloom.llm import decontaminate as D
from markloom.llm import license as lic
from markloom.llm import lines, pieces, pii, sharding, simhash, suffixes, toxicity
from markloom.llm.components import connected_components

TEXT = "doc_id long, text string"
#: null, empty and repeated rows, a null id, and a long text
EDGE = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "a b c"), (4, "x" * 40_000), (5, "é ü\n\n \tÉ"), (6, "\0\x0b z")]


def frame(spark, rows, schema=TEXT, clash=()):
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit("clash") for c in clash})


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def prose(rng, n, words=None):
    return " ".join(rng.choice(words or [f"w{i}" for i in range(200)]) for _ in range(n))


# --- decontamination --------------------------------------------------------------------------------------------------


def contaminated(docs, items):
    out = {}
    pats = {(tuple(w[i : i + 10]) if len(w) >= 10 else tuple(w), k if k is None else str(k)) for k, t in items if (w := D.words_of((t or "").encode())) for i in range(max(1, len(w) - 9))}
    for k, t in docs:
        w = D.words_of((t or "").encode())
        hit, found = set(), set()
        for p, item in pats:
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    found |= {item} - {None}
        out.setdefault(k, []).append((len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontaminate(spark, block_bytes):
    rng = random.Random(1)
    words = ["Ab", "c", "dé", "E9", "f"]
    items = [(k, prose(rng, rng.choice([1, 2, 9, 10, 11, 30]), words)) for k in range(8)] + [(8, ""), (9, None), (None, "Ab c"), (0, "c Ab")]
    docs = [(100 + k, prose(rng, rng.randint(0, 120), words)) for k in range(12)] + [(200 + k, prose(rng, 20, words) + "; " + (items[k][1] or "")) for k in range(8)] + EDGE
    found = D.digest(D.find(spark, frame(spark, docs, clash=("n_words", "items", "spans", "h")), frame(spark, items, "item_id long, text string"), block_bytes=block_bytes))
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    assert {k: sorted(v) for k, v in got.items()} == contaminated(docs, items)


def test_decontaminate_without_rows(spark):
    none, items = frame(spark, []), frame(spark, [], "item_id long, text string")
    assert D.find(spark, none, items).count() == 0
    assert D.digest(D.find(spark, frame(spark, EDGE), items)).where("contaminated").count() == 0


def test_cut_leaves_clean_documents_alone(spark):
    items = frame(spark, [(1, " ".join(f"b{i}" for i in range(15)))], "item_id long, text string")
    hit = "before, " + ", ".join(f"B{i}" for i in range(15)) + " after"
    docs = frame(spark, [(1, hit), (2, "clean Text"), (3, None), (4, " ".join(f"b{i}" for i in range(15)))])
    got = {r.doc_id: r.text for r in D.remove_contaminated(spark, docs, items).collect()}
    assert got == {1: "before,  after", 2: "clean Text", 3: None}


def test_cut_is_the_same_in_blocks(spark):
    rng = random.Random(4)
    passage = [f"b{i}" for i in range(30)]
    # windows 1 and 2 overlap; the c words of document 2 become neighbours once the rest is cut
    items = [(1, " ".join(passage[:10])), (2, " ".join(passage[5:16])), (3, " ".join(passage[11:25])), (4, "c1 c2 c3 c4 c5 c6 c7 c8 c9 c10"), (5, "x y"), (None, "clean")]
    docs = [(1, "before, " + ", ".join(passage) + " after"), (2, "c1 c2 c3 c4 c5 " + " ".join(passage[:25]) + " c6 c7 c8 c9 c10"), (3, "x " + " ".join(passage[:10]) + " y"), (4, None), (5, ""), (6, "clean"), (7, " ".join(passage[:16])), (8, "x y"), (8, "x y"), (None, "ü x y é"), (8, "x Y z")]
    docs += [(100 + k, prose(rng, 60, ["x", "y", *passage[:3], "é;"])) for k in range(30)]
    docs, items = frame(spark, docs, clash=("spans", "lang")), frame(spark, items, "item_id long, text string")
    whole, small = (D.remove_contaminated(spark, docs, items, block_bytes=n) for n in (1 << 20, 1))
    assert small.columns == whole.columns == docs.columns
    told = sorted(map(tuple, whole.collect()), key=str)
    assert sorted(map(tuple, small.collect()), key=str) == told
    texts = {r[0]: r[1] for r in told}
    assert texts[1] == "before, , " + ", ".join(passage[25:]) + " after" and texts[3] == "x  y" and 7 not in texts
    assert texts[2].split() == [f"c{i}" for i in range(1, 11)]


# --- lines --------------------------------------------------------------------------------------------------------------


def deduped_lines(docs, least):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(str.maketrans(lines.UPPER, lines.LOWER))
    split = [(t or "").split("\n") for _, t in docs]
    df = {}
    for s in split:
        for k in {key(x) for x in s}:
            df[k] = df.get(k, 0) + 1
    out = []
    for (k, _), s in zip(docs, split, strict=True):
        kept = [x for x in s if not key(x) or df[key(x)] < least]
        out.append((k, len(s), len(s) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches,fan_in", [(4, 4), (7, 2), (1, 2)])
def test_lines(spark, batches, fan_in):
    rng = random.Random(2)
    pool = ["Same line", "same LINE\t", "", "  ", "É", "é", "solo\r", "tail"] + [f"l{i}" for i in range(30)]
    docs = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for k in range(40)] + EDGE
    got = lines.digest(lines.dedup_lines(spark, frame(spark, docs, clash=("gone", "t", "h1", "batch")), 3, batches, fan_in))
    assert sorted((tuple(r) for r in got.collect()), key=str) == deduped_lines(docs, 3)


def test_lines_of_no_documents(spark):
    assert lines.dedup_lines(spark, frame(spark, [])).count() == 0


def test_runs_compact_and_anti_join(spark):
    runs = lines.LevelledRuns(spark, fan_in=2)
    for k in range(5):
        own = runs.write(lines.batch_counts(lines.line_keys(frame(spark, [(k, f"shared\nown{k}")]))).drop("batch"))
        assert runs.unseen(own).count() == (2 if k == 0 else 1)
        plan = runs.unseen(own)._jdf.queryExecution().executedPlan().toString()
        assert k == 0 or ("LeftAnti" in plan and "Exchange" not in plan)
        runs.add(own)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert sorted(r.n for r in runs.counts().collect()) == [1, 1, 1, 1, 1, 5]


def test_one_line_of_any_length(spark):
    docs = [(k, "A" * 300_000 + "\n" + f"own {k}") for k in range(3)] + [(9, "\n".join(f"l{i}" for i in range(20_000)))] * 3
    got = lines.digest(lines.dedup_lines(spark, frame(spark, docs), 3))
    assert sorted((tuple(r) for r in got.collect()), key=str) == deduped_lines(docs, 3)


# --- toxicity -------------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for k in range(600):
        words = prose(rng, 60).split()
        bad = k % 8 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["idiot", "grumblak", "snorfix"]) + rng.choice(["", "", "ed"])
        docs.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    df = frame(spark, docs + [(1000, None), (1001, ""), (None, "a")], clash=("score", "toxic", "predicted", "label"))
    got = toxicity.classify(spark, df, frame(spark, labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    assert len(got) == 603
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert {r.predicted for r in got if r.doc_id in (None, 1000, 1001)} == {0}


def test_toxicity_sees_no_held_out_label(spark):
    docs = frame(spark, [(k, f"text {k}") for k in range(40)])
    labels = frame(spark, [(k, 1) for k in range(40)], "doc_id long, toxic int")
    texts, known = toxicity.learning_rows(docs, labels)
    assert not {f"text {k}" for k in range(40) if zlib.crc32(str(k).encode()) % 4 == 2} & set(texts)


def test_toxicity_learns_from_a_bounded_sample(spark):
    text = lambda k: f"text {k} " + "x" * 100
    docs = [(k, text(k)) for k in range(400)] + [(7, text(7))] * 3000 + [(7, "other")] + [(401, "y" * 3_000_000), (402, None)]
    labels = [(k, k % 2) for k in range(200)] + [(7, 0), (401, 1), (402, 0), (None, 1)]
    texts, known = toxicity.learning_rows(frame(spark, docs), frame(spark, labels, "doc_id long, toxic int"), rows=90, most_bytes=1 << 20)
    assert len(texts) <= 120 and sum(map(len, texts)) <= 1 << 20 and "y" not in {t[:1] for t in texts}
    whole, known = toxicity.learning_rows(frame(spark, docs), frame(spark, labels, "doc_id long, toxic int"), rows=4000)
    found = {t: k for t, k in zip(whole, known, strict=True)}
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 != 2 and k != 7]
    assert all(found[text(k)] == (k % 2 if k < 200 else -1) for k in ids)
    # the id that is labelled 0 and 1 is toxic, and one of its texts is learned from
    assert (found.get(text(7)), found.get("other")) in ((1, None), (None, 1), (None, None))


def test_label_model_finds_accuracies_and_pairs():
    import numpy as np

    rng = np.random.default_rng(5)
    truth = (rng.random(4000) < 0.3).astype(int)
    vote = lambda right, said: np.where(rng.random(4000) < said, np.where(rng.random(4000) < right, 2 * truth - 1, 1 - 2 * truth), 0)
    a, b, c = vote(0.9, 0.8), vote(0.8, 0.9), vote(0.7, 0.9)
    twin = np.where(rng.random(4000) < 0.95, c, 0)
    label = np.where(rng.random(4000) < 0.3, 2 * truth - 1, 0)
    label[:60] = np.where(label[:60] == 0, 0, -label[:60])  # some are wrong
    votes = np.column_stack([a, b, c, twin, label])
    post, shares, pairs = toxicity.label_model(votes, 0.3, np.where(label > 0, 0.95, np.where(label < 0, 0.05, 0.3)))
    assert pairs[0] == (2, 3)
    best = sum(np.log(r / (1 - r)) * v for r, v in ((0.9, a), (0.8, b), (0.7, c))) + np.log(0.3 / 0.7)
    free = label == 0
    assert ((post >= 0.5) == truth)[free].mean() > ((best > 0) == truth)[free].mean() - 0.01
    right = shares[:3, 2, 1] / (shares[:3, 2, 1] + shares[:3, 0, 1])
    assert np.abs(right - [0.9, 0.8, 0.7]).max() < 0.05
    # labels don't dictate the posterior
    assert ((post >= 0.5) != (label > 0))[:60][label[:60] != 0].any()


def test_toxicity_without_labels_or_rows(spark):
    none = frame(spark, [], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.classify(spark, frame(spark, [(1, "you stupid idiot, moron"), (2, "a fine day")]), none).collect()}
    assert got == {1: 1, 2: 0}
    assert toxicity.classify(spark, frame(spark, []), none).count() == 0


# --- licences -------------------------------------------------------------------------------------------------------------


def test_licences(spark):
    docs = [(11, "prose\nReleased under the MIT License.\nmore"), (12, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."), (13, "a license to drive\nthe general public"), *EDGE]
    got = {r.doc_id: (r.n_licence, r.families) for r in lic.digest(lic.scan(spark, frame(spark, docs, clash=("found",)))).collect()}
    assert got == {11: (1, "MIT"), 12: (2, "Apache-2.0,CC-BY-NC"), 13: (0, "")} | {k: (0, "") for k, _ in EDGE}
    assert lic.scan(spark, frame(spark, [])).count() == 0


def test_all_rights_reserved_alone(spark):
    docs = [(1, "All rights reserved."), (2, "prose before\nCopyright 2020 Ada Lovelace. All rights reserved.\nprose"), (3, "all seats are reserved by rights\nall rights")]
    got = {r.doc_id: (r.n_licence, r.families) for r in lic.digest(lic.scan(spark, frame(spark, docs))).collect()}
    assert got == {1: (1, "Proprietary"), 2: (1, "Proprietary"), 3: (0, "")}


def test_licence_tags_and_more_families(spark):
    docs = [(1, "# SPDX-License-Identifier: MIT"), (2, "x\nLicensed under the ISC License."), (3, "Licensed under CC BY-SA 3.0."), (4, "// SPDX-License-Identifier: EPL-2.0\n" + "prose " * 60_000)]
    got = {r.doc_id: r.families for r in lic.digest(lic.scan(spark, frame(spark, docs))).collect()}
    assert got == {1: "MIT", 2: "ISC", 3: "CC-BY-SA", 4: "EPL-2.0"}


def test_every_confirmed_paragraph_has_a_cue():
    model = lic.train()
    cue = lic.cues(model.templates)
    rng = random.Random(4)
    for family, templates in model.templates.items():
        for t in templates:
            ordered = sorted(t)
            for _ in range(20):
                # the fewest shingles that confirm it, those without a cue first
                few = sorted(ordered, key=lambda s: (not cue.isdisjoint(s), rng.random()))[: -(-len(t) * 4 // 5)]
                assert not cue.isdisjoint(w for s in few for w in s), family


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction"
BSD = "# Redistribution and use in source and binary forms, with or without\r\n# modification, are permitted provided that the following conditions are met:\r\n#\r\n# 1. Redistributions of source code"
GPL = " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version {} of the License, or\n * (at your option) any later version."


def test_wrapped_licences(spark):
    docs = [(1, "prose\n\n" + MIT), (2, BSD), (3, GPL.format(3)), (4, GPL.format(2)), (5, MIT + "\n" + MIT + "\n\n" + BSD), (6, "Released under the MIT\nLicense. All rights\nreserved.")]
    docs += [(7, MIT.replace("copy\n", "copy\n\n")), (8, "Released under the MIT License.\nReleased under the MIT License."), (9, MIT.replace("\n", " ")), (10, "the terms of the GNU\nGeneral Public License\nas published")]
    got = {r.doc_id: ([x.line for x in r.found], [x.family for x in r.found]) for r in lic.scan(spark, frame(spark, docs)).collect()}
    assert got == {
        1: ([2], ["MIT"]),
        2: ([0], ["BSD"]),
        3: ([1], ["GPL-3.0"]),
        4: ([1], ["GPL-2.0"]),
        5: ([0, 3, 7], ["MIT", "MIT", "BSD"]),
        6: ([0, 1], ["MIT", "Proprietary"]),
        7: ([], []),
        8: ([0, 1], ["MIT", "MIT"]),
        9: ([0], ["MIT"]),
        10: ([], []),
    }


def test_licence_model_held_out():
    model = lic.train()
    kept = [(w, f) for k, (w, f) in enumerate(lic.training_paragraphs()) if k % 5 == 4 and (f == lic.UNKNOWN or model.confirmed(w, f))]
    right = sum(model.predict(w)[0] == f for w, f in kept)
    assert right >= 0.97 * len(kept)
    assert all(model.predict(lic.words_of(t.encode()))[0] == f for f, ts in lic.TEMPLATES.items() for t in ts)


# --- SimHash ----------------------------------------------------------------------------------------------------------------


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shard_rows", [4096, 8])
def test_simhash_links(spark, shard_rows):
    rng = random.Random(4)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    tied = {r.node: r.root for r in connected_components(spark, simhash.links(spark, df, shard_rows)).collect()}
    m = (1 << 64) - 1
    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & m).bit_count() <= 4]
    assert {x: tied.get(x, x) for x in signed} == plain_components(signed, near)


def test_simhash_documents(spark):
    rng = random.Random(5)
    base = prose(rng, 120).split()
    docs = [(10 + k, " ".join(base[: 60 + k // 4] + [f"n{k}"] * (k % 2) + base[60 + k // 4 :])) for k in range(12)] + [(50 + k, prose(rng, 80)) for k in range(10)] + EDGE
    rows = simhash.digest(simhash.near_duplicates(spark, frame(spark, docs, clash=("fp", "component_id", "root")))).collect()

    def fingerprint(t):
        import xxhash

        w = [x for x in re.split(r"[\x20\x09-\x0d]+", (t or "").translate(str.maketrans(lines.UPPER, lines.LOWER))) if x]
        s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    want = [(k, fingerprint(t)) for k, t in docs]
    assert sorted(((r.doc_id, r.fingerprint) for r in rows), key=str) == sorted(((k, f"{x:016x}") for k, x in want), key=str)
    nodes = {x for _, x in want}
    tied = plain_components(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 4])
    least = {}
    for k, x in want:
        if k is not None:
            least[tied[x]] = min(k, least.get(tied[x], k))
    of = dict(want)
    assert all(r.component_id == least[tied[of[r.doc_id]]] for r in rows if r.doc_id is not None)
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert simhash.near_duplicates(spark, frame(spark, [])).count() == 0


def test_one_row_of_each_component_stays(spark):
    copy, other, third = (prose(random.Random(k), 60) for k in (5, 6, 7))
    docs = [(5, copy), (5, other), (3, copy), (3, copy), (None, copy), (None, third), (None, third), (9, None), (8, "")]
    kept = simhash.keep_one(spark, frame(spark, docs, clash=("fp", "root", "kept", "n", "text_key")))
    assert kept.columns == ["doc_id", "text", "fp", "root", "kept", "n", "text_key"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, copy), (5, other), (None, third), (8, "")], key=str)
    assert simhash.keep_one(spark, frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(200, 260)] + [(300, k) for k in range(301, 360)] + [(None, 1), (5, 5)]
    got = {r.node: r.root for r in connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == plain_components({x for e in real for x in e}, real)
    assert connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


# --- sharding ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n,partition_rows", [(1000, 90), (5, 2), (0, 10)])
def test_sharding(spark, n, partition_rows):
    docs = [(k, "t" * (k % 7)) for k in range(n)] + (EDGE if n else [])
    rows = sharding.digest(sharding.assign(spark, frame(spark, docs, clash=("size", "slot", "part")), partition_rows=partition_rows)).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str) == sorted(((k, len((t or "").encode()) + 8, None if t is None else zlib.crc32(t.encode())) for k, t in docs), key=str)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots.get(s, [])) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_texts_are_moved_with_their_rows(spark):
    docs = [(k % 5, f"text {k}") for k in range(70)] + EDGE
    for n in (0, len(docs)):
        rows = sharding.shuffled(spark, frame(spark, docs[:n], clash=("row", "shard", "slot", "part")), 6, 4).collect()
        assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted(docs[:n], key=str)
        slots = {}
        for r in rows:
            slots.setdefault(r["__shard"], []).append(r["__slot"])
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_copies_are_spread(spark):
    rows = sharding.assign(spark, frame(spark, [(1, "same")] * 2400), partition_rows=100).groupBy("shard").count().collect()
    assert [r["count"] for r in rows] == [100] * 24


def test_communication_matrix():
    import numpy as np

    have = np.array([100, 0, 3, 57])
    m = sharding.communication_matrix(have, 24)
    assert (m.sum(1) == have).all() and m.sum(0).max() - m.sum(0).min() <= 1
    draws = np.array([sharding.communication_matrix(np.array([50, 50]), 2, seed)[0, 0] for seed in range(400)])
    assert abs(draws.mean() - 25) < 0.5 and 1.5 < draws.var() < 11  # hypergeometric: 25 and 6.3


# --- SentencePiece ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk_bytes", [8 << 20, 300])
def test_pieces_match_the_library(spark, chunk_bytes, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(pieces, "GROUP_UNITS", 50)

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(7)
    docs = [(10 + k, prose(rng, 30) + rng.choice(["", " ", "\n", "  ", "日本 😀", "ﬁ", "aaaaaaa"])) for k in range(30)] + [(90, "abc" * 3000)] + EDGE
    df = frame(spark, docs, clash=("ids", "bucket", "part"))
    encoded = pieces.encode(spark, df, chunk_bytes=chunk_bytes)
    got = sorted(((r.doc_id, list(r.ids), r.round_trip) for r in encoded.collect()), key=str)
    assert got == sorted(((k, lib.encode(t or ""), True) for k, t in docs), key=str)
    back = {r.doc_id: r.text for r in pieces.decode(spark, encoded).collect()}
    assert all(back[k] == (t or "") for k, t in docs)
    assert pieces.encode(spark, frame(spark, [])).count() == 0


def test_viterbi_fold_is_the_best_path(spark):
    rng = random.Random(8)
    names = ["<unk>", "a", "b", "ab", "ba", "aba", "bb", "aab"]
    score = [0.0] + [-rng.random() * 5 for _ in names[1:]]
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(12)] + ["aXb"]
    table = spark.createDataFrame([(n, i, score[i]) for i, n in enumerate(names) if i], "piece string, id int, score double")
    df = spark.createDataFrame([(i, w) for i, w in enumerate(dict.fromkeys(words))], "num int, word string")
    edges = pieces.lattice(df, table, 3, ["num"])
    folded = df.join(edges, "num").select("word", pieces.viterbi(F.col("edges"), F.length("word"), F.lit(min(score))).alias("ids"))

    def best(w):
        state = {0: (0.0, [])}
        for e in range(1, len(w) + 1):
            state[e] = max([(state[s][0] + score[names.index(w[s:e])], state[s][1] + [names.index(w[s:e])]) for s in range(max(0, e - 3), e) if w[s:e] in names[1:]] + [(state[e - 1][0] + min(score) - 10, state[e - 1][1] + [0])])
        return state[len(w)][1]

    assert {r.word: list(r.ids) for r in folded.collect()} == {w: best(w) for w in dict.fromkeys(words)}


def test_best_paths_score_no_less_than_merges(spark):
    model = pieces.load()
    words = [" the", " internationalisation", "aaaa", " x" * 3, "", None, "\u2581y", "日本", "z" * 600]
    df = spark.createDataFrame(list(enumerate(words)), "num int, word string")
    got = {r.num: list(r.path) for r in pieces.best_paths(spark, df, ["num"]).collect()}
    assert set(got) == {0, 1, 2, 3, 6, 7}
    score = lambda ids: sum(model.score[i] if i != model.unknown else model.score[list(model.pieces.values())].min() - 10 for i in ids)
    for k in (0, 1, 2):
        shown = words[k].replace(" ", pieces.SPACE)
        assert "".join(next(p for p, i in model.pieces.items() if i == x) for x in got[k]) == shown
        merged = pieces.encode_text(words[k][1:], model) if words[k][0] == " " else None
        assert merged is None or score(got[k]) >= score(merged) - 1e-9


# --- PII ----------------------------------------------------------------------------------------------------------------------


def test_pseudonyms(spark):
    values = ["4785380592391139", "4785 3805 9239 1139", "+1 (743) 555-3824", "555.123.4567", "152.143.123.131", "1984-02-29", "12/31/1999", "31.12.1999", "2001/01/02", "123-45-6789", "jo.doe9@mail5.example.com"]
    clean = ["1234567890123456", "999.1.1.1", "2001-02-30", "31/12/1999", "no digits", "1.2.3.4.5", "01.2.3.4", "12345"]
    docs = [(10 + k, f"see {v}, again {v}.") for k, v in enumerate(values)] + [(100 + k, f"see {v} there") for k, v in enumerate(clean)] + EDGE
    done = pii.pseudonymise(frame(spark, docs, clash=("each", "found", "values")))
    rows = {}
    for r in done.collect():
        rows[r.doc_id] = r
    for k, v in enumerate(values, 10):
        found = rows[k]["__found"]
        assert len(found) == 2 and found[0] == found[1] and found[0].value == v
        new = found[0].pseudonym
        assert rows[k]["__text"] == f"see {new}, again {new}." and new != v
        if found[0].kind in ("card", "phone", "ssn", "date"):
            assert re.sub(r"\d", "9", new) == re.sub(r"\d", "9", v)
    assert rows[10]["__found"][0].pseudonym == re.sub(" ", "", rows[11]["__found"][0].pseudonym)
    for k, v in enumerate(clean):
        assert not rows[100 + k]["__found"] and rows[100 + k]["__text"] == f"see {v} there"
    assert pii.digest(done).count() == len(docs)
    back = pii.pseudonymise(done.select("doc_id", F.col("__text").alias("text")), undo=True)
    assert sorted((r["__text"] or "" for r in back.collect())) == sorted(t or "" for _, t in docs)
    assert pii.pseudonymise(frame(spark, [])).count() == 0


def test_permutations_are_one_to_one(spark):
    df = spark.range(1000).select(pii.permute_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "card", False).alias("x"), pii.date(F.date_format(F.date_add(F.lit("1999-12-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd"), "k", False).alias("d"))
    assert df.select("x").distinct().count() == 1000 and df.select("d").distinct().count() == 1000


def test_pseudonyms_run_no_python(spark):
    plan = pii.digest(pii.pseudonymise(frame(spark, EDGE)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pseudonyms_in_a_long_text(spark):
    text = "call 555.123.4567 or 555.123.4567; " * 4000
    row = pii.pseudonymise(frame(spark, [(1, text), (2, "see 555.123.4567")])).orderBy("doc_id").collect()
    new = row[1]["__found"][0].pseudonym
    assert row[0]["__text"] == text.replace("555.123.4567", new) and len(row[0]["__found"]) == 8000


# --- repeated strings -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("length,chunk_bytes,bits", [(200, 4 << 20, (36, 56)), (200, 900, (36, 56)), (24, 500, (36, 56)), (200, 2000, (3, 2)), (24, 1 << 20, (36, 3))])
def test_suffixes(spark, length, chunk_bytes, bits, monkeypatch):
    """With two or three bits most keys collide, within a chunk and between chunks."""
    monkeypatch.setattr(suffixes, "SEGMENT", 1 << 12)
    rng = random.Random(9)
    passage = prose(rng, 90)
    docs = []
    for k in range(25):
        a = rng.randrange(len(passage) - 10)
        docs.append((k, prose(rng, 40) + passage[a : a + rng.choice([100, 199, 200, 201, 260, 333])] + prose(rng, rng.randint(0, 30))))
    docs += [(80, passage), (81, passage), (82, "é" * 150), (83, "ab" * 300), *EDGE]
    got = suffixes.digest(suffixes.remove_repeats(spark, frame(spark, docs, clash=("part", "chunk", "lens")), length, chunk_bytes, 1000, bits))
    raw = [(t or "").encode() for _, t in docs]
    want = [(k, len(b), *r) for (k, _), b, r in zip(docs, raw, suffixes.brute_force(raw, length), strict=True)]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_suffixes_of_nothing(spark):
    assert suffixes.remove_repeats(spark, frame(spark, [])).count() == 0
    assert suffixes.digest(suffixes.remove_repeats(spark, frame(spark, [(1, None)]))).first().kept_sha256 == sha(b"")


def test_cover_has_every_difference():
    c = suffixes.COVER
    assert {(a - b) % suffixes.PERIOD for a in c for b in c} == set(range(suffixes.PERIOD))


# --- shared storage ---------------------------------------------------------------------------------------------------------------


def test_text_batches_only_lower_the_setting(spark):
    from markloom.llm import common

    before = spark.conf.get(common.BATCH_ROWS)
    try:
        spark.conf.set(common.BATCH_ROWS, "10000")
        common.text_batches(spark, 1000)
        assert spark.conf.get(common.BATCH_ROWS) == "1000"
        common.text_batches(spark, 5000)
        assert spark.conf.get(common.BATCH_ROWS) == "1000"
        with common.number_batches(spark, 7000):
            assert spark.conf.get(common.BATCH_ROWS) == "7000"
        assert spark.conf.get(common.BATCH_ROWS) == "1000"
    finally:
        spark.conf.set(common.BATCH_ROWS, before)


def test_bucket_keys_fill_all_buckets(spark):
    from markloom.llm import common

    keys = common.bucket_keys(spark, 13)
    df = spark.createDataFrame([(k,) for k in keys], "id long").select(F.pmod(F.hash("id"), F.lit(13)).alias("b"))
    assert [r.b for r in df.collect()] == list(range(13))
