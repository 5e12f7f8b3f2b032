"""Word overlap of all pairs against brute force."""

import pytest

from markloom.operators import overlap


@pytest.mark.parametrize("block_items", [2, 100])
def test_all_pairs(spark, block_items):
    docs = [(1, ["a", "b", "c"]), (2, []), (3, None), (None, ["b"]), (1, ["a", "b", "c"])]
    items = [(10, ["a", "b"]), (11, ["z"]), (12, []), (13, None), (14, ["c", "b", "q"])]
    got = overlap.all_pairs(spark, spark.createDataFrame(docs, "doc_id long, words array<string>"), spark.createDataFrame(items, "item_id long, words array<string>"), block_items)
    expected = []
    for d, a in docs:
        for k, b in items:
            a, b = set(a or ()), set(b or ())
            expected.append((d, k, len(a & b), len(a & b) / len(b) if b else 0.0, len(a & b) / len(a | b) if a | b else 0.0))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


def test_every_item_is_answered(spark):
    from markloom.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    n_items, n_docs = (spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("benchmark", "documents"))
    got = QUERIES["token_recall_all"](spark, sf)
    assert got.select("item_id").distinct().count() == n_items and got.count() == n_items * n_docs
