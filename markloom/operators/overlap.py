"""Word overlap of all documents with all items."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Pairs of an Arrow batch.
PAIRS = 1 << 16
SCHEMA = "doc_id long, item_id long, matched long, recall double, jaccard double"


def all_pairs(spark: SparkSession, docs: DataFrame, items: DataFrame, block_items: int) -> DataFrame:
    """doc_id, item_id, matched, recall, jaccard of each row of `docs` (doc_id, words) with each of `items` (item_id, words).

    Words are distinct in a row; null counts as none. Items come in blocks through the driver; a block's items by word
    are broadcast, and a document adds up those of its words. Where an item has no words its recall is 0, where both
    have none the Jaccard value is 0. No text moves.
    """
    out, rows = None, items.toLocalIterator()
    while block := list(islice(rows, block_items)):
        by_word: dict[str, list[int]] = {}
        for k, row in enumerate(block):
            for word in row.words or ():
                by_word.setdefault(word, []).append(k)
        ids = pa.array([row.item_id for row in block], pa.int64())
        sizes = np.array([len(row.words or ()) for row in block], np.int64)
        shared = spark.sparkContext.broadcast((ids, sizes, {w: np.array(ks, np.int32) for w, ks in by_word.items()}))
        part = docs.select("doc_id", "words").mapInArrow(_pairs(shared), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def _pairs(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, by_word = shared.value
        n, names = len(ids), ["doc_id", "item_id", "matched", "recall", "jaccard"]
        step = max(1, PAIRS // n)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                words = batch.column(1).to_pylist()
                matched = np.zeros((len(words), n), np.int64)
                for i, own in enumerate(words):
                    hits = [by_word[w] for w in own or () if w in by_word]
                    if hits:
                        matched[i] = np.bincount(np.concatenate(hits), minlength=n)
                either = np.array([len(own or ()) for own in words], np.int64)[:, None] + sizes - matched
                pick = np.repeat(np.arange(len(words)), n)
                rest = np.tile(np.arange(n), len(words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()).take(pa.array(pick)), ids.take(pa.array(rest)), pa.array(matched.ravel()), pa.array((matched / np.maximum(1, sizes)).ravel()), pa.array((matched / np.maximum(1, either)).ravel())],
                    names=names,
                )

    return run
