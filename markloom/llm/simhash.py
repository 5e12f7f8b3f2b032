"""SimHash near-duplicates found in BK-trees.

Equal fingerprints are one node. Two fingerprints that differ in at most 4 of 64 bits agree in at least 2 of 6 blocks
of bits, so the fingerprints are dealt to 15 families of shards, one for each pair of blocks, keyed by those blocks'
bits; each link lies whole in some shard. A shard's fingerprints form a BK-tree whose children are keyed by their
Hamming distance to the parent; the other fingerprints of the shard descend only along edges within the radius. A
shard of more than SHARD_ROWS is cut into parts: the tree of each part is sent to the tasks of all parts, so no task
holds more than two parts. A task returns a spanning forest of its links, never the pairs.

Fewer than 4 words are one shingle; no words give fingerprint zero, which links like any other. Null text is empty.
Texts of any length are hashed whole; a bit that is set in exactly half the shingles is 0. Rows with a null doc_id link
too, but give no component_id. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import number_batches, text_batches, text_bytes, write_shared
from .components import connected_components

SHINGLE = 4
RADIUS = 4
SEED = 42
SHARD_ROWS = 4096
SMALL_TREE = 24
#: Width of the 6 blocks of bits, from the lowest.
BLOCKS = (11, 11, 11, 11, 10, 10)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    count = len(words) - size + 1
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:count].tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for k in range(0, count, 65_536):
        ones += np.unpackbits(hashes[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), text_key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t) for t in batch.text), np.uint64, len(batch))
            yield pd.DataFrame({"doc_id": batch.doc_id.astype("Int64"), "fp": fp.view(np.int64), "text_key": batch.text_key})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), _text_key().alias("text_key")).mapInPandas(run, "doc_id long, fp long, text_key binary")


class Forest:
    """Union by relabelling; keeps the links that joined two trees."""

    def __init__(self, values: np.ndarray):
        self.values, self.label, self.links = values, np.arange(len(values)), []

    def join(self, x: int, others: np.ndarray) -> None:
        """Links x to each of `others`."""
        strange = others[self.label[others] != self.label[x]]
        while len(strange):
            y = int(strange[0])
            self.links.append((int(self.values[x]), int(self.values[y])))
            self.label[self.label == self.label[y]] = self.label[x]
            strange = strange[self.label[strange] != self.label[x]]


def tree_of(bits: np.ndarray, rows: np.ndarray) -> tuple[int, dict]:
    """BK-tree (root, {distance: subtree}) over bits[rows], which are distinct."""
    root = (int(rows[0]), {})
    todo = [(root, rows[1:])]
    while todo:
        (node, children), rest = todo.pop()
        if not len(rest):
            continue
        far = np.bitwise_count(bits[rest] ^ bits[node])
        for d in np.unique(far):
            own = rest[far == d]
            children[int(d)] = (int(own[0]), {})
            todo.append((children[int(d)], own[1:]))
    return root


def search(bits: np.ndarray, tree: tuple[int, dict], queries: np.ndarray, radius: int, forest: Forest) -> None:
    """All queries descend together; a child at distance c is entered by those whose distance d has |d - c| <= radius."""
    todo = [(tree, queries)]
    while todo:
        (node, children), own = todo.pop()
        d = np.bitwise_count(bits[own] ^ bits[node]).astype(np.int16)
        near = own[(d <= radius) & (own != node)]
        if len(near):
            forest.join(node, near)
        for c, child in children.items():
            if len(inner := own[np.abs(d - c) <= radius]):
                todo.append((child, inner))


def small_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Forest of a few distinct values: each one searches the tree of those before it and is then hung into it."""
    links, root = [], (values[0], {})
    label = {v: v for v in values}
    for q in values[1:]:
        todo, near = [root], []
        while todo:
            node, children = todo.pop()
            d = (node ^ q).bit_count()
            if d <= radius:
                near.append(node)
            todo += [x for c, x in children.items() if abs(c - d) <= radius]
        for v in near:
            if label[v] != label[q]:
                links.append((v, q))
                old, new = label[v], label[q]
                label = {k: new if x == old else x for k, x in label.items()}
        at = root
        while (nxt := at[1].get(c := (at[0] ^ q).bit_count())) is not None:
            at = nxt
        at[1][c] = (q, {})
    return links


def shard_links(fps: np.ndarray, part: np.ndarray, a: int, b: int, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Forest of the links within part a == b, or between parts a and b, of one shard of distinct fingerprints."""
    if len(fps) == 2 and a == b:  # the tree is a root, and the one query looks at it
        x, y = int(fps[0]), int(fps[1])
        return [(x, y)] if (x ^ y).bit_count() <= radius else []
    if len(fps) <= SMALL_TREE and a == b:
        return small_links([int(x) for x in fps], radius)
    forest, rows = Forest(fps), np.arange(len(fps))
    own, others = rows[part == a], rows[part == b]
    if len(own) and len(others):
        search(fps, tree_of(fps, own), others, radius, forest)
    return forest.links


def shards_of(fp: str = "fp"):
    """The 15 (family, key) of a fingerprint."""
    at, bits = 0, []
    for width in BLOCKS:
        bits.append(F.shiftrightunsigned(F.col(fp), at).bitwiseAND((1 << width) - 1))
        at += width
    return F.array(*(F.struct(F.lit(k).alias("family"), (bits[i] * 2048 + bits[j]).cast("int").alias("key")) for k, (i, j) in enumerate(combinations(range(6), 2))))


def links(spark: SparkSession, distinct: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges (a, b) that join the same fingerprints as all links do; `distinct` has each fp once."""
    dealt = distinct.select("fp", F.explode(shards_of()).alias("s")).select("fp", "s.family", "s.key")
    large = dealt.groupBy("family", "key").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows).select("family", "key", F.ceil(F.col("n") / shard_rows).cast("int").alias("parts"))
    cut = dealt.join(large, ["family", "key"], "left")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.lit("part"), "fp"), F.col("parts"))).cast("int")
    cut = cut.withColumn("part", part).withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    cut = cut.select("fp", "family", "key", "part", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"))
    keys = ["family", "key", "a", "b"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            ids = batch[keys].to_numpy()
            edge = np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1
            last = int(edge[-1]) if len(edge) else 0
            held = batch.iloc[last:]
            yield solve(batch.fp.to_numpy()[:last], batch.part.to_numpy()[:last], ids[:last], np.concatenate([[0], edge]) if last else np.zeros(1, int))
        if held is not None and len(held):
            yield solve(held.fp.to_numpy(), held.part.to_numpy(), held[keys].to_numpy(), np.array([0, len(held)]))

    def solve(fp, part, ids, edge) -> pd.DataFrame:
        out, bits = [], fp.view(np.uint64)
        for k in np.flatnonzero(np.diff(edge) > 1):
            lo, hi = edge[k], edge[k + 1]
            out += shard_links(bits[lo:hi], part[lo:hi], int(ids[lo][2]), int(ids[lo][3]))
        pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return cut.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, fp, text_key (128 bits of the text), component_id, and kept: whether the row is the one of its component that stays.

    That is the smallest id, then the smallest text_key; rows without an id come last. Equal rows are kept together.
    """
    text_batches(spark)
    prints = write_shared(spark, fingerprints(docs), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(row).alias("first"))
    with number_batches(spark):
        tied = connected_components(spark, links(spark, nodes.select("fp"), shard_rows))
    rooted = nodes.join(tied.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "first", F.coalesce("root", "fp").alias("root"))
    # written, so that the join on a large component's root can be split
    least = write_shared(spark, rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("stays")), "least")
    ids = rooted.select("fp", "root").join(least, "root").select("fp", "component_id", "stays")
    return prints.join(ids, "fp").select("doc_id", "fp", "text_key", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), (row == F.col("stays")).alias("kept"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row of each component: the one with the smallest id, also where ids repeat or are null. Of equal rows one stays."""
    kept = near_duplicates(spark, docs).where("kept").groupBy("doc_id", "text_key").agg(F.count("*").alias("n"))
    kept = write_shared(spark, kept, "kept").select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__k"), F.col("n").alias("__n"))
    own = docs.withColumn("__key", _text_key())
    out = own.join(kept, own["doc_id"].cast("long").eqNullSafe(kept["__d"]) & (own["__key"] == kept["__k"]))
    if kept.where("__n > 1").limit(1).count():
        again = out.where("__n > 1").dropDuplicates(["doc_id", "__key"])
        out = out.where("__n = 1").unionByName(again)
    return out.select(*docs.columns)


def _text_key():
    return F.unhex(F.md5(text_bytes()))
