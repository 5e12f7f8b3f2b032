"""The pipeline's stages against plain Python on a small corpus."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from markloom.llm import decontaminate, lines, pieces, simhash, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe") for b in ("ra", "so", "ti", "vu", "xe", "zo")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = " ".join(f"item{i}" for i in range(14))
    docs, labels = [], []
    for k in range(160):
        body = [text(rng.randint(30, 60)) for _ in range(3)]
        if k % 6 == 0:
            body.append("You stupid idiot, moron")
        if k % 4 == 0:
            body.append("Shared footer line")
        if k % 10 == 3:
            body.append(f"{text(3)} {passage} {text(3)}")
        docs.append((k, "\n".join(body), "en", f"s{k % 3}", 0))
        labels.append((k, 1, int(k % 6 == 0)))
    docs += [(500 + k, docs[k][1] + " tail", "en", "s", 0) for k in range(1, 30, 2)] + [(600, None, "en", "s", None), (601, "", None, "s", 0), (601, "", None, "s", 0)]
    where = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def test_pipeline(spark, folder):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    model = toxicity.train(*toxicity.learning_rows(read("documents"), read("labels")))
    docs = [(k, t) for k, t in docs if model.score(t) < 0.3]
    assert not [k for k, t in docs if t and "idiot" in t] and {601, 1, 2, 3} <= {k for k, _ in docs}

    key = lambda x: x.strip(lines.WHITE).lower()  # noqa: E731  ASCII texts
    seen: dict[str, int] = {}
    for _, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            seen[k] = seen.get(k, 0) + 1
    docs = [(k, t if t is None else "\n".join(x for x in t.split("\n") if not key(x) or seen[key(x)] < 10)) for k, t in docs]
    assert not [k for k, t in docs if t and "Shared footer" in t]

    prints = [simhash.fingerprint((t or "").encode()) for _, t in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and root[i] != root[j]:
                root = [root[j] if x == root[i] else x for x in root]
    least = {r: min(docs[i][0] for i in range(len(docs)) if root[i] == r) for r in set(root)}
    docs = [d for d, r in zip(docs, root, strict=True) if d[0] == least[r]]

    tables = decontaminate.tables([("1", read("benchmark").first().text.encode())])
    docs = [(k, t if t is None else decontaminate.cut_text(t, tables)) for k, t in docs]
    assert not [k for k, t in docs if t and "item5" in t]

    want = sorted((k, library.encode(t or "")) for k, t in docs)
    got = P.run(spark, folder).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in got) == want
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


def test_stages_keep_columns_and_clean_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        assert out.where("doc_id = 2").count() == 1
    assert len(P.STAGES) == 5 and np.all([callable(f) for _, f in P.STAGES])


def test_stages_on_odd_rows(spark, folder):
    rows = [(None, None, None, None), (None, "", "en", "s"), (7, "\ud7ff é\n\n", "en", "s"), (7, "\ud7ff é\n\n", "en", "s"), (8, None, "en", "s"), (9, "x" * 200_000, "en", "s"), (10, "a fine day\n" * 30, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("score", "__row", "key", "spans", "fp", "batch", "h1", "n", "t"):
        docs = docs.withColumn(name, F.lit(name))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
        # empty texts are one component, and its smallest id stays
        want = [(7, rows[2][1]), (8, None), (9, rows[5][1]), (10, rows[6][1])] if name.startswith("simhash") else [(k, t) for k, t, *_ in rows]
        assert got == sorted(want, key=str), name
    last = P.STAGES[-1][1](spark, docs, folder).collect()
    assert sorted((str(r.doc_id), r.round_trip) for r in last) == sorted((str(r[0]), True) for r in rows)


def test_no_documents(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert P.run(spark, f"file://{tmp_path}").count() == 0
