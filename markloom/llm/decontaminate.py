"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Each window of a benchmark item is a pattern whose symbols are words. For every pattern length there is one set of
tables: SHIFT gives, for a block of two words, how far the search may jump without passing an occurrence; a block with
shift 0 leads through the suffix bucket to the few patterns that end in it; those are compared word by word.

Null, empty and wordless texts have no words and no hits. Items without words have no windows. Rows with a null or
repeated doc_id are answered row by row. Repeated item_ids are one item; the windows of an item without id count as
hits, but it is named nowhere. Texts of any length are searched whole; ties don't arise, as spans are merged. Of the
inputs only doc_id, item_id and text are read, so other columns may have any name.

The items come in blocks of bounded bytes. The tables of one block are built and broadcast at a time; with several
blocks each search is written before the next, as the hits of each distinct text, and the union of their spans counts.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_LIMIT_BYTES, text_batches, text_bytes, write_shared

WINDOW = 10
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of the items' texts in a block.
BLOCK_BYTES = BROADCAST_LIMIT_BYTES // 32
HITS = "key binary, items array<string>, spans array<struct<first:int,last:int>>"
SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<first:int,last:int>>"


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class WuManber:
    """Patterns of one length, as tuples of words."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(dict)  # last block -> pattern -> items

    def add(self, pattern: tuple[bytes, ...], item: str | None) -> None:
        b = self.block
        for end in range(b, self.length + 1):
            block = pattern[end - b : end]
            self.shift[block] = min(self.shift.get(block, self.far), self.length - end)
        self.buckets[pattern[-b:]].setdefault(pattern, set()).update([] if item is None else [item])

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """The last word of each occurrence, with the items it belongs to."""
        m, b, far, shift, n = self.length, self.block, self.far, self.shift, len(words)
        at = m - 1
        while at < n:
            block = tuple(words[at - b + 1 : at + 1])
            step = shift.get(block, far)
            if step:
                at += step
                continue
            items = self.buckets[block].get(tuple(words[at - m + 1 : at + 1]))
            if items is not None:
                yield at, items
            at += 1


def windows(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def tables(items: list[tuple[str, bytes]], size: int = WINDOW) -> list[WuManber]:
    by_length: dict[int, WuManber] = {}
    for item, text in items:
        for pattern in windows(words_of(text), size):
            by_length.setdefault(len(pattern), WuManber(len(pattern))).add(pattern, item)
    return list(by_length.values())


def scan(words: list[bytes], searches: list[WuManber]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged spans of hit words, both ends included, and the items that occur."""
    found, items = [], set()
    for search in searches:
        for last, own in search.search(words):
            found.append((last - search.length + 1, last))
            items |= own
    return merged(found), items


def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, sorted; neighbours become one."""
    spans: list[tuple[int, int]] = []
    for first, last in sorted(found):
        if spans and first <= spans[-1][1] + 1:
            spans[-1] = (spans[-1][0], max(last, spans[-1][1]))
        else:
            spans.append((first, last))
    return spans


def blocks_of_items(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of at most `limit` bytes of text (or one item); they stream through the driver."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), text_bytes().alias("t")).distinct()
    block, held = [], 0
    for row in rows.toLocalIterator():
        if block and held + len(row.t) > limit:
            yield block
            block, held = [], 0
        block.append((row.i, bytes(row.t)))
        held += len(row.t)
    if block:
        yield block


def find(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items, spans for each document."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    blocks = _searches(spark, benchmark, size, block_bytes)
    first = next(blocks, None)
    second = next(blocks, None)
    if second is None:
        return narrow.mapInPandas(_answer(first), SCHEMA)
    # the rows keep their ids and numbers of words; the hits meet them by the text, and no text moves
    counted = write_shared(spark, narrow.withColumn("key", _key()).mapInPandas(_words, "doc_id long, key binary, n_words long"), "counted")
    found = hits(spark, narrow, itertools.chain([first, second], blocks))
    done = counted.join(found, "key", "left")
    none = lambda c: F.expr(f"cast(array() as {dict(found.dtypes)[c]})")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["last"] - s["first"] + 1)
    return done.select("doc_id", "n_words", F.coalesce(n_hit, F.lit(0)).alias("n_hit"), *(F.coalesce(c, none(c)).alias(c) for c in ("items", "spans")))


def _searches(spark: SparkSession, benchmark: DataFrame, size: int, block_bytes: int) -> Iterator:
    """The broadcast tables of each block of items. A block's text is bounded, and the tables take about 30 times its bytes."""
    text_batches(spark)
    for block in blocks_of_items(benchmark, block_bytes):
        yield spark.sparkContext.broadcast(tables(block, size))


def _answer(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        searches = shared.value if shared else []
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.doc_id, batch.text, strict=True):
                words = words_of(text)
                spans, items = scan(words, searches)
                out.append((doc_id, len(words), sum(b - a + 1 for a, b in spans), sorted(items), [{"first": a, "last": b} for a, b in spans]))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_hit", "items", "spans"]).astype({"doc_id": "Int64"})

    return run


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch.doc_id.astype("Int64"), "key": batch.key, "n_words": [len(words_of(t)) for t in batch.text]})


def _key(text: str = "text"):
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def hits(spark: SparkSession, docs: DataFrame, searches: Iterator) -> DataFrame:
    """key, items and merged spans of each distinct text with a hit. Each block's search is written before the next one's tables are built."""
    found = None
    for shared in searches:
        part = write_shared(spark, docs.select(_key().alias("key"), text_bytes().alias("text")).mapInPandas(_hits(shared), HITS), "hits")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    found = found.groupBy("key").agg(F.flatten(F.collect_set("items")).alias("items"), F.flatten(F.collect_set("spans")).alias("spans"))

    def unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = [[{"first": a, "last": b} for a, b in merged([(s["first"], s["last"]) for s in own])] for own in batch.spans]
            yield pd.DataFrame({"key": batch.key, "items": [sorted(set(own)) for own in batch["items"]], "spans": spans})

    return write_shared(spark, found.mapInPandas(unite, HITS), "united")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def item_sha256(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def remove_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents with every hit word cut out, from the first byte of a span to its last; clean ones as they are.

    Every block of items searches the unchanged texts; the union of the blocks' spans is cut once. With several blocks
    the spans meet the rows by a hash of the text, as equal texts have equal spans. A document left without anything but
    spaces is dropped if it had a hit. Columns stay as they are, whatever their names.
    """
    blocks = _searches(spark, benchmark, size, block_bytes)
    first = next(blocks, None)
    second = next(blocks, None)
    if first is None:
        return docs
    if second is None:
        return _cut(docs, _searched(first), "text")
    found = hits(spark, docs.where("text is not null"), itertools.chain([first, second], blocks)).select(F.col("key").alias("__key"), F.col("spans").alias("__spans"))
    return _cut(docs.withColumn("__key", _key()).join(found, "__key", "left"), _merged_and_cut, "text", "__spans").select(*docs.columns)


def _hits(shared):
    """The key, items and spans of each text with a hit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text in zip(batch.key, batch.text, strict=True):
                spans, items = scan(words_of(text), shared.value)
                if spans:
                    out.append((key, sorted(items), [{"first": a, "last": b} for a, b in spans]))
            yield pd.DataFrame(out, columns=["key", "items", "spans"])

    return run


def _searched(shared):
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else cut_text(t, shared.value))

    return cut


def _merged_and_cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([t if t is None or own is None else cut_spans(t, merged([(s["first"], s["last"]) for s in own])) for t, own in zip(texts, spans, strict=True)], dtype=object)


def _cut(docs: DataFrame, cut, *columns: str) -> DataFrame:
    cut_udf = F.pandas_udf(cut, "string")
    name = "__cut"
    done = docs.withColumn(name, cut_udf(*columns))
    kept = done.where(F.col(name).eqNullSafe(F.col("text")) | (F.length(F.trim(F.coalesce(F.col(name), F.lit("")))) > 0))
    return kept.withColumn("text", F.col(name)).drop(name)


def cut_text(text: str, searches: list[WuManber]) -> str:
    spans, _ = scan(words_of(text.encode()), searches)
    return cut_spans(text, spans)


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans, which are merged, and what is between them."""
    if not spans:
        return text
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.lower())]
    out, last = [], 0
    for first, end in spans:
        out.append(raw[last : at[first][0]])
        last = at[end][1]
    return b"".join([*out, raw[last:]]).decode()
