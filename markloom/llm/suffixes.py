"""Removal of repeated byte strings by a distributed difference-cover algorithm.

Two equal strings of LENGTH bytes have, for every offset between them, a shift below PERIOD at which both positions
are sampled (a perfect difference cover modulo PERIOD; positions count within their document). So:

1. Sample and name: the TUPLE = LENGTH - PERIOD + 1 bytes at each sampled position are sorted; equal neighbours
   share a name, and a position whose tuple is unique is in no repeat at that shift.
2. Recurse: matches end at LENGTH bytes, so the recursion on names ends after one level, with the full length as the
   next tuple. Only positions at most PERIOD - 1 before a sampled one with a shared name are left.
3. Merge: those positions, sampled or not, are sorted by their LENGTH bytes in one order.
4. Compare: adjacent equal prefixes are repeats; their bytes are removed.

The texts are cut into chunks and written once, bucketed by the writing task, so that the answers of the sorts are
joined to them without moving a text again. A chunk sends each value once, as sorted and packed differences, and gets
back one bit for each: which of them another chunk has too. Sort keys are hashes with a base drawn for each run: 36
bits and the bucket for tuples (a false match only leaves a position to the second sort), 56 bits and a bucket from a
second hash for the full length. Buckets are dealt by hash of the bytes, so a hot passage is one value in one bucket,
from each chunk once.

Equal keys are then compared. Of each group one chunk is the carrier. Every chunk answers a bucket with one number, the
sum of the second hash's other bits over its shared strings, times a random factor for each key, the carrier's counted
once less than the group has members, with a minus. These sums add up to zero where the strings of each group agree in
all 120 bits. In a bucket where they don't, the strings themselves are sent, and counted byte by byte.

Each row is a document; equal rows repeat each other, and ties have no order to break. Null and empty texts have no
bytes and nothing removed. A text may be of any length: it is hashed in segments, and what else is held of it grows with
its repeats. Only doc_id and text are read; a null doc_id is kept as it is.
"""

from __future__ import annotations

import hashlib
import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import bucket_keys, pack_sorted, text_batches, text_bytes, trim, unpack_sorted, write_bucketed, write_shared

LENGTH = 200
PERIOD = 133
#: A perfect difference cover modulo 133 (every difference occurs).
COVER = (0, 1, 25, 30, 40, 46, 53, 96, 100, 114, 122, 131)
CHUNK_BYTES = 4 << 20
#: Bytes that are hashed at once.
SEGMENT = 1 << 17
#: Values of a bucket on average, which one task sorts.
BUCKET_VALUES = 2_000_000
NAME_BITS, FULL_BITS = 36, 56
WORD = 1 << 64


@dataclass
class Hashes:
    """Two rolling hashes modulo 2^64, of random bytes' values and random bases."""

    bits: tuple[int, int]
    seed: int

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self.byte = rng.integers(1 << 62, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.mix = rng.integers(1 << 62, size=3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        bases = [int(x) * 8 + 5 for x in rng.integers(1 << 60, size=2)]
        self.up, self.down = ([_powers(f(base)) for base in bases] for f in (lambda x: x, lambda x: pow(x, -1, WORD)))

    def of(self, data: np.ndarray, at: np.ndarray, length: int, k: int) -> np.ndarray:
        """Hash k of the `length` bytes at the sorted positions `at`."""
        out = np.empty(len(at), np.uint64)
        edge = np.searchsorted(at, np.arange(0, len(data) + SEGMENT, SEGMENT))
        sums = np.zeros(SEGMENT + length + 1, np.uint64)
        for block in np.flatnonzero(np.diff(edge)).tolist():
            lo, hi, x = edge[block], edge[block + 1], block * SEGMENT
            own = self.byte[k][data[x : x + SEGMENT + length]]
            own *= self.up[k][: len(own)]
            np.cumsum(own, out=sums[1 : len(own) + 1])
            here = at[lo:hi] - x
            out[lo:hi] = (sums[here + length] - sums[here]) * self.down[k][here]
        return self.mixed(out)

    def mixed(self, x: np.ndarray) -> np.ndarray:
        x = x ^ (x >> np.uint64(32))
        x *= self.mix[0]
        x ^= x >> np.uint64(29)
        x *= self.mix[1]
        return x ^ (x >> np.uint64(32))

    def factor(self, value: np.ndarray) -> np.ndarray:
        return self.mixed(value * self.mix[2]) | np.uint64(1)


def _powers(base: int) -> np.ndarray:
    steps = np.full(SEGMENT + LENGTH + 1, base % WORD, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ... n[0] numbers, then those from lo[1], and so on."""
    ends = np.cumsum(n)
    return np.repeat(lo - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


class Chunk:
    """Some documents, one after the other, with what the sorts ask of them."""

    def __init__(self, data: bytes, lens: np.ndarray, length: int, hashes: Hashes):
        self.data, self.length, self.hashes = np.frombuffer(data, np.uint8), length, hashes
        self.period, self.cover = (PERIOD, COVER) if length > PERIOD + 16 else (7, (1, 2, 4))
        self.ends = np.cumsum(lens)
        self.starts = self.ends - lens

    def sampled(self) -> np.ndarray:
        """Positions of the cover with a whole tuple in their document, in order."""
        long = self.ends - self.starts >= self.length
        starts, ends = self.starts[long], self.ends[long]
        turns = -(-(ends - starts) // self.period)
        base = np.repeat(starts, turns) + self.period * ranges(np.zeros(len(turns), np.int64), turns)
        at = base[:, None] + np.array(sorted(c % self.period for c in self.cover))
        return at[at + (self.length - self.period + 1) <= np.repeat(ends, turns)[:, None]]

    def names(self, buckets: int) -> Values:
        return Values(self, self.sampled(), self.length - self.period + 1, self.hashes.bits[0], buckets)

    def candidates(self, shared: np.ndarray, buckets: int) -> Values:
        """Positions from which a sampled position in `shared` is less than PERIOD away, with a whole string ahead."""
        doc = np.searchsorted(self.ends, shared, "right")
        hi = np.minimum(shared, self.ends[doc] - self.length) + 1
        lo = np.maximum(np.maximum(shared - self.period + 1, self.starts[doc]), np.concatenate([[0], np.maximum.accumulate(hi)[:-1]]) if len(hi) else hi)
        return Values(self, ranges(lo, np.maximum(hi - lo, 0)), self.length, self.hashes.bits[1], buckets)

    def spans(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The union of the strings at the sorted positions: each run's document, first byte and end."""
        doc = np.searchsorted(self.ends, repeated, "right")
        new = np.ones(len(repeated) + 1, bool)
        new[1:-1] = (np.diff(repeated) > self.length) | (np.diff(doc) > 0)
        first = np.flatnonzero(new)
        return doc[first[:-1]], repeated[first[:-1]], repeated[first[1:] - 1] + self.length


class Values:
    """Positions with their keys: what a chunk sends to each bucket, and what the answers say of the positions."""

    def __init__(self, chunk: Chunk, at: np.ndarray, length: int, bits: int, buckets: int):
        self.chunk, self.at, self.length = chunk, at, length
        value = chunk.hashes.of(chunk.data, at, length, 0) >> np.uint64(64 - bits)
        other = chunk.hashes.of(chunk.data, at, length, 1)
        bucket = (((other >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.uint16 if buckets < 1 << 16 else np.int32)
        order = np.argsort(value)
        self.order = order = order[np.argsort(bucket[order], kind="stable")]
        v, b = value[order], bucket[order]
        self.first = np.ones(len(v), bool)
        self.first[1:] = (v[1:] != v[:-1]) | (b[1:] != b[:-1])
        self.unique, self.bucket, self.check = v[self.first], b[self.first].astype(np.int32), other[order]
        self.begins = np.flatnonzero(self.first)
        self.edge = np.searchsorted(self.bucket, np.arange(int(self.bucket.max(initial=-1)) + 2))

    def blobs(self) -> Iterator[tuple[int, bytes]]:
        for b in np.flatnonzero(np.diff(self.edge)).tolist():
            yield b, pack_sorted(self.unique[self.edge[b] : self.edge[b + 1]])

    def flags(self, answers: list[dict]) -> np.ndarray:
        """Of the unique keys, those which this chunk has twice or another chunk has too."""
        flags = np.diff(self.begins, append=len(self.order)) > 1
        for x in answers:
            own = slice(self.edge[x["bucket"]], self.edge[x["bucket"] + 1])
            flags[own] |= np.unpackbits(np.frombuffer(zlib.decompress(x["mask"]), np.uint8), count=own.stop - own.start).astype(bool)
        return flags

    def positions(self, flags: np.ndarray) -> np.ndarray:
        """The positions of the unique keys with a flag, in order."""
        return np.sort(self.at[self.order[np.repeat(flags, np.diff(self.begins, append=len(self.order)))]])

    def sums(self, answers: list[dict]) -> Iterator[tuple[int, int]]:
        """For each bucket what is to add up to zero over all chunks; a number that can't where this chunk itself has two strings with one key."""
        sizes = np.diff(self.begins, append=len(self.order))
        check = self.check[self.begins]
        same = np.ones(len(self.unique), bool)
        same[sizes > 1] = (np.maximum.reduceat(self.check, self.begins) == np.minimum.reduceat(self.check, self.begins))[sizes > 1] if len(self.begins) else True
        for x in answers:
            own = slice(self.edge[x["bucket"]], self.edge[x["bucket"] + 1])
            if not same[own].all():
                yield x["bucket"], random.SystemRandom().getrandbits(64)
                continue
            shared = np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(x["mask"]), np.uint8), count=own.stop - own.start))
            weights = np.frombuffer(zlib.decompress(x["weights"]), np.int32).astype(np.int64).view(np.uint64)
            yield x["bucket"], int((weights * check[own][shared] * self.chunk.hashes.factor(self.unique[own][shared])).sum(dtype=np.uint64))

    def strings(self, answers: list[dict], buckets: set[int]) -> Iterator[tuple[bytes, int]]:
        """The strings whose key is shared, in some buckets, with the number of their positions."""
        for at in self._in(answers, buckets):
            yield self.chunk.data[at : at + self.length].tobytes(), 1

    def _in(self, answers: list[dict], buckets: set[int]) -> list[int]:
        return self.positions(self.flags(answers) & np.isin(self.bucket, list(buckets))).tolist()

    def repeated(self, answers: list[dict], buckets: set[int], strings: set[bytes]) -> np.ndarray:
        """The positions of repeats: by key, but in `buckets` by their strings."""
        flags = self.flags(answers)
        if not buckets:
            return self.positions(flags)
        found = [at for at in self._in(answers, buckets) if self.chunk.data[at : at + self.length].tobytes() in strings]
        return np.sort(np.concatenate([self.positions(flags & ~np.isin(self.bucket, list(buckets))), np.array(found, np.int64)]))


TEXTS = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int32())), ("body", pa.binary())])
SENT = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())])
SUMS = pa.schema([("bucket", pa.int32()), ("high", pa.int64()), ("low", pa.int64())])
STRINGS = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("string", pa.binary()), ("n", pa.int64())])
KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def chunks(docs: DataFrame, chunk_bytes: int, keys: list[int]) -> DataFrame:
    """part (one of `keys` for a task), chunk, doc_ids, lens, body. Chunk numbers are random: a task that runs again writes new ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, pack = random.SystemRandom(), zstandard.ZstdCompressor(level=1)
        part, ids, texts, held = keys[TaskContext.get().partitionId() % len(keys)], [], [], 0

        def row() -> pa.RecordBatch:
            return _batch([[part], [rng.getrandbits(62)], [ids], [[len(t) for t in texts]], [pack.compress(b"".join(texts))]], TEXTS)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                raw = text.as_py()
                if ids and held + len(raw) > chunk_bytes:
                    yield row()
                    ids, texts, held = [], [], 0
                ids.append(doc_id.as_py())
                texts.append(raw)
                held += len(raw)
        if ids:
            yield row()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return source.mapInArrow(run, from_arrow_schema(TEXTS))


def shared_values(sent: DataFrame, weighed: bool) -> DataFrame:
    """The sort: of each blob's values, one bit for those that another chunk has too, and how many of them there are.

    With `weighed`, for these also the weights of sums(): the first of k chunks has 1 - k, the others 1. Answers are
    grouped by chunk.
    """

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack_sorted(b) for b in pdf.blob]
        values = np.concatenate(parts)
        order = np.argsort(values, kind="stable")
        ranked = values[order]
        first = np.ones(len(values) + 1, bool)
        first[1:-1] = ranked[1:] != ranked[:-1]
        flags = np.empty(len(values), bool)
        flags[order] = ~(first[:-1] & first[1:])
        if weighed:
            begins = np.flatnonzero(first)
            weight, of = np.ones(len(values), np.int32), np.empty(len(values), np.int32)
            weight[begins[:-1]] = 1 - np.diff(begins)
            of[order] = weight
        masks, weights, at = [], [], 0
        for p in parts:
            own = flags[at : at + len(p)]
            masks.append(zlib.compress(np.packbits(own).tobytes(), 1))
            weights.append(zlib.compress(of[at : at + len(p)][own].tobytes(), 1) if weighed else None)
            at += len(p)
        return pdf[["part", "chunk", "bucket"]].assign(mask=masks, weights=weights, n=[int(flags.sum()), *[0] * (len(parts) - 1)])

    answers = sent.groupBy("bucket").applyInPandas(sort, "part long, chunk long, bucket int, mask binary, weights binary, n long")
    return answers.groupBy("part", "chunk").agg(F.collect_list(F.struct("bucket", "mask", "weights")).alias("masks"), F.sum("n").alias("n"))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield {name: batch.column(name)[k].as_py() for name in batch.schema.names}


def _open(row: dict, length: int, hashes: Hashes) -> Chunk:
    return Chunk(zstandard.ZstdDecompressor().decompress(row["body"]), np.asarray(row["lens"], np.int64), length, hashes)


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, chunk_bytes: int = CHUNK_BYTES, bucket_values: int = BUCKET_VALUES, bits: tuple[int, int] = (NAME_BITS, FULL_BITS)) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for each document. Fewer `bits` make no other result, but more strings to compare."""
    if length < 16 or length > LENGTH:
        raise ValueError(f"strings of under 16 bytes have no room for a cover, and those over {LENGTH} no powers")
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text_batches(spark)
    cut = write_bucketed(spark, chunks(docs, chunk_bytes, bucket_keys(spark, tasks)), "chunks", tasks, ["part"], compression="none")
    total = cut.select(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    name_buckets = max(tasks, total * len(COVER) // PERIOD // bucket_values + 1)
    seed = random.SystemRandom().getrandbits(62)

    def each(answer, schema: pa.Schema):
        """A function of a chunk and its row, over all rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = Hashes(bits, seed)
            for batch in batches:
                for row in _rows(batch):
                    yield answer(_open(row, length, hashes), row)
            trim()

        return lambda frame: frame.mapInArrow(run, from_arrow_schema(schema))

    def send(row: dict, values: Values) -> pa.RecordBatch:
        found = list(values.blobs())
        return _batch([[row["part"]] * len(found), [row["chunk"]] * len(found), [b for b, _ in found], [x for _, x in found]], SENT)

    def left(chunk: Chunk, row: dict, buckets: int) -> Values:
        names = chunk.names(name_buckets)
        return chunk.candidates(names.positions(names.flags(row["masks"] or [])), buckets)

    texts = cut.select("part", "chunk", "lens", "body")
    named = write_shared(spark, shared_values(each(lambda chunk, row: send(row, chunk.names(name_buckets)), SENT)(texts), False), "names")
    with_names = _join(texts, named, "masks")
    # a shared name opens the positions up to the next one; there is one in PERIOD / len(COVER)
    opened = (named.agg(F.sum("n")).first()[0] or 0) * PERIOD // len(COVER)
    buckets = max(tasks, opened // bucket_values + 1)
    full = write_shared(spark, shared_values(each(lambda chunk, row: send(row, left(chunk, row, buckets)), SENT)(with_names), True), "repeats")
    with_both = _join(with_names, full.withColumnRenamed("masks", "repeats"), "repeats")

    def check(chunk: Chunk, row: dict) -> pa.RecordBatch:
        found = list(left(chunk, row, buckets).sums(row["repeats"] or []))
        return _batch([[b for b, _ in found], [x >> 32 for _, x in found], [x & 0xFFFFFFFF for _, x in found]], SUMS)

    low = F.sum("low")
    off = (low % (1 << 32) != 0) | ((F.sum("high") + F.floor(low / (1 << 32))) % (1 << 32) != 0)
    unsure = {r.bucket for r in each(check, SUMS)(with_both).groupBy("bucket").agg(off.alias("off")).where("off").collect()}
    ready = _join(with_both, cut.select("part", "chunk", "doc_ids"), "doc_ids")
    if unsure:
        ready = _join(ready, _compared(spark, each, with_both, left, buckets, unsure), "strings")

    def remove(chunk: Chunk, row: dict) -> pa.RecordBatch:
        values = left(chunk, row, buckets)
        doc, first, end = chunk.spans(values.repeated(row["repeats"] or [], unsure, set(row.get("strings") or [])))
        edge = np.zeros(len(chunk.data) + 1, np.int8)
        edge[first] += 1
        edge[end] -= 1
        n = len(chunk.ends)
        n_bytes, removed = chunk.ends - chunk.starts, np.bincount(doc, end - first, n).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(n_bytes - removed)]).astype(np.int32)
        kept = chunk.data[np.cumsum(edge[:-1], dtype=np.int8) == 0] if len(first) else chunk.data
        texts = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
        return _batch([row["doc_ids"], n_bytes, removed, np.bincount(doc, minlength=n), texts], KEPT)

    return each(remove, KEPT)(ready)


def _compared(spark: SparkSession, each, with_both: DataFrame, left, buckets: int, unsure: set[int]) -> DataFrame:
    """part, chunk and those of the chunk's strings in the buckets `unsure` that occur twice: counted as they are."""

    def tell(chunk: Chunk, row: dict) -> pa.RecordBatch:
        found = list(left(chunk, row, buckets).strings(row["repeats"] or [], unsure))
        return _batch([[row["part"]] * len(found), [row["chunk"]] * len(found), [x for x, _ in found], [n for _, n in found]], STRINGS)

    told = write_shared(spark, each(tell, STRINGS)(with_both).groupBy("part", "chunk", "string").agg(F.sum("n").alias("n")), "strings")
    twice = told.groupBy("string").agg(F.sum("n").alias("all")).where("all > 1")
    return told.join(twice, "string", "left_semi").groupBy("part", "chunk").agg(F.collect_list("string").alias("strings"))


def _join(cut: DataFrame, answers: DataFrame, column: str) -> DataFrame:
    """Joined on the bucketing column alone, so that the chunks stay in place; the chunk is compared on top."""
    right = answers.select(F.col("part").alias("__p"), F.col("chunk").alias("__c"), column)
    return cut.join(right, (F.col("part") == F.col("__p")) & (F.col("chunk") - F.col("__c") == 0), "left").drop("__p", "__c")


def digest(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, str]]:
    """(n_removed, n_spans, kept_sha256) by a dictionary of all strings; for small tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out
