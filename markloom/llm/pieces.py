"""SentencePiece encoding and decoding over a relational lattice.

A text is cut into units that no piece reaches over: at spaces, and between neighbours that no piece has side by side.
So each distinct unit is encoded once. The units go to buckets by hash; their substrings of at most the longest piece's
length are exploded and equi-joined to the piece table, which gives the lattice's edges, grouped by unit and folded by
a higher-order aggregate: for BPE models over merge steps, each of which takes the best ranked, then leftmost edge that
joins two tokens (`merge_fold`); for unigram models over ends, with the best path to each (`viterbi`). A best path by
score isn't what a BPE model defines. Characters outside the piece table fall back to bytes, or to the unknown id if the
model has no bytes.

Texts are read once. What moves is a chunk's distinct units, packed by bucket; what comes back is a bit for each of
their characters, whether a token begins there. The sequence of units stays in a table bucketed by the task that wrote
it, and is joined to the answers there.

The piece table is broadcast; its size is that of the model file. Null text is empty and has no ids. Bytes that aren't
UTF-8 are replaced, and such a row doesn't make the round trip. Rows are encoded one by one: repeated and null ids need
no rule. A text may be of any length; a unit of more than FOLD_LENGTH characters is merged by a heap instead of the
fold, whose steps would be quadratic. Only doc_id and text are read.
"""

from __future__ import annotations

import heapq
import random
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import bucket_keys, text_batches, text_bytes, trim, write_bucketed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
WORD = r" *[^ ]+| +"
CHUNK_BYTES = 12 << 20
LEVEL = 1
#: Units of the documents that are put together at once.
GROUP_UNITS = 100_000
#: Buckets per shuffle partition.
BUCKETS = 4
#: A unit is exploded in pieces of so many first characters, so that a very long one is no quadratic string.
SEGMENT = 512
MAX_ID, MAX_LEN, MAX_START = 1 << 20, 64, 1 << 36
#: Characters of a unit whose token boundaries fit into the fold's state, a long.
FOLD_LENGTH = 62
#: Texts whose encoding tells a model with another algorithm or with a normaliser.
PROBES = ("the quick  brown fox,", "ﬁ Ａ½ é e\u0301 \u00ad", " lead and trail \t\n", "unbelievably internationalisation", "aaaaaaaa 12345")


@dataclass
class Model:
    pieces: dict[str, int]
    score: np.ndarray
    surface: list[bytes]
    bytes_at: int | None
    unknown: int
    unit: str

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces))

    @property
    def rank(self) -> np.ndarray:
        """The place of each id in the order of merges."""
        return np.unique(-self.score, return_inverse=True)[1].astype(np.int64)


def load(path: str = MODEL) -> Model:
    """The table of a model file. The library reads the file; it encodes nothing but PROBES, which must come out alike."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(m.get_piece_size())
    normal = {m.id_to_piece(i): i for i in ids if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}
    if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in normal) or max(map(len, normal)) >= MAX_LEN or len(ids) > MAX_ID:
        raise ValueError("pieces that reach over words, or too many or too long, aren't supported")
    byte_ids = [i for i in ids if m.is_byte(i)]
    surface = [b"" if m.is_control(i) else bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else " ⁇ ".encode() if m.is_unknown(i) else m.id_to_piece(i).replace(SPACE, " ").encode() for i in ids]
    # neighbouring unknowns are one token: where they are, a unit must be a whole word
    model = Model(normal, np.array([m.get_score(i) for i in ids]), surface, byte_ids[0] if byte_ids else None, m.unk_id(), unit_pattern(normal) if byte_ids else WORD)
    for probe in PROBES:
        if encode_text(probe, model) != m.encode(probe):
            raise ValueError("only BPE models that take a text as it is are supported")
    return model


def unit_pattern(pieces) -> str:
    """A pattern whose matches no piece reaches over.

    Characters that stand side by side in some piece are of one kind, and so on; a unit is a run of spaces with a run
    of one kind after it.
    """
    kind: dict[str, str] = {}

    def of(c: str) -> str:
        while kind.setdefault(c, c) != c:
            kind[c] = c = kind[kind[c]]
        return c

    for p in pieces:
        p = p.lstrip(SPACE)
        for a, b in zip(p, p[1:], strict=False):
            kind[of(a)] = of(b)
    kinds = defaultdict(list)
    for c in kind:
        kinds[of(c)].append(c)
    runs = sorted((sorted(k) for k in kinds.values()), key=lambda k: (-len(k), k))
    return "|".join([*(f" *[{''.join(map(re.escape, k))}]+" for k in runs), r" *[^ ]", " +"])


def units_of(text: str, unit: re.Pattern) -> list[str]:
    return unit.findall(" " + text.replace(SPACE, " ")) if text else []


def encode_text(text: str, model: Model) -> list[int]:
    """The ids of one text, here and now."""
    out, rank = [], model.rank
    for u in units_of(text, re.compile(model.unit, re.S)):
        word = u.replace(" ", SPACE)
        edges = [_edge(rank[model.pieces[word[a:b]]], a, b - a) for a in range(len(word)) for b in range(a + 2, min(len(word), a + MAX_LEN) + 1) if word[a:b] in model.pieces]
        starts = np.array(merge_long(len(word), edges)[:-1])
        out += ids_of(word, starts, np.zeros(len(starts)), model.pieces, model.bytes_at, model.unknown)[0].tolist()
    return out


def _edge(rank: int, start: int, length: int) -> int:
    return (int(rank) * MAX_START + start) * MAX_LEN + length


def piece_frame(spark: SparkSession, model: Model) -> DataFrame:
    ids = list(model.pieces.values())
    return spark.createDataFrame(pd.DataFrame({"piece": list(model.pieces), "id": ids, "rank": model.rank[ids]}), "piece string, id int, rank long")


def spans(words: DataFrame, pieces: DataFrame, longest: int, keys: list[str], shortest: int = 1) -> DataFrame:
    """keys, start, length and the piece's columns for each substring of the units in column `word` (SPACE for spaces) that is a piece.

    The join is on a hash of the substring, a number, and the strings are compared where the hashes agree.
    """
    at = F.explode(F.sequence(F.lit(0), F.floor((F.length("word") - 1) / SEGMENT).cast("int")))
    cut = words.select(*keys, "word", at.alias("segment")).select(*keys, (F.col("segment") * SEGMENT).alias("base"), F.substr("word", F.col("segment") * SEGMENT + 1, F.lit(SEGMENT + longest - 1)).alias("cut"))
    starts = cut.select("*", F.explode(F.sequence(F.lit(1), F.least(F.length("cut"), F.lit(SEGMENT)))).alias("start"))
    tails = starts.select(*keys, (F.col("base") + F.col("start") - 1).cast("long").alias("start"), F.substr("cut", F.col("start"), F.lit(longest)).alias("tail"))
    subs = tails.select(*keys, "start", "tail", F.explode(F.when(F.length("tail") >= shortest, F.sequence(F.lit(shortest), F.length("tail"))).otherwise(F.array().cast("array<int>"))).alias("length"))
    subs = subs.select(*keys, "start", "length", F.substr("tail", F.lit(1), F.col("length")).alias("sub")).withColumn("hash", F.xxhash64("sub"))
    # said as two prefixes, since an equality would become part of the key
    same = F.startswith("sub", F.col("piece")) & F.startswith("piece", F.col("sub"))
    table = pieces.where(F.length("piece") >= shortest).withColumn("piece_hash", F.xxhash64("piece"))
    edges = subs.join(F.broadcast(table), (F.col("hash") == F.col("piece_hash")) & same)
    return edges.select(*keys, "start", "length", *(c for c in pieces.columns if c != "piece"))


def lattice(words: DataFrame, pieces: DataFrame, longest: int, keys: list[str]) -> DataFrame:
    """The edges of each unit as one array of (start, length, id, score), for `viterbi`."""
    return spans(words, pieces, longest, keys).groupBy(*keys).agg(F.collect_list(F.struct("start", "length", "id", "score")).alias("edges"))


def best_paths(spark: SparkSession, words: DataFrame, keys: list[str], model_path: str = MODEL) -> DataFrame:
    """`words` (word) with the ids of the path with the best score through its lattice: what a unigram model of the same pieces would say.

    A word may be of any length in principle, but the fold's steps look at all its edges: words of more than SEGMENT
    characters have no path here. Null and empty words have none either. Repeated words are answered one by one.
    """
    model = load(model_path)
    ids = list(model.pieces.values())
    table = spark.createDataFrame(pd.DataFrame({"piece": list(model.pieces), "id": ids, "score": model.score[ids]}), "piece string, id int, score double")
    shown = words.where(F.length("word").between(1, SEGMENT)).withColumn("word", F.replace("word", F.lit(" "), F.lit(SPACE)))
    edges = lattice(shown, table, model.longest, keys)
    path = viterbi(F.coalesce("edges", F.expr("cast(array() as array<struct<start:bigint,length:int,id:int,score:double>>)")), F.length("word"), F.lit(float(model.score[ids].min())), model.unknown)
    return shown.join(edges, keys, "left").withColumn("path", path).select(*keys, "word", "path")


def merges(words: DataFrame, pieces: DataFrame, longest: int, keys: list[str]) -> DataFrame:
    """keys, n and edges of each unit that has pieces of two characters or more, as numbers in the order of merging."""
    packed = ((F.col("rank") * MAX_START + F.col("start")) * MAX_LEN + F.col("length")).alias("edge")
    own = [*keys, "n"]
    return spans(words.withColumn("n", F.length("word")), pieces, longest, own, shortest=2).select(*own, packed).groupBy(*own).agg(F.array_sort(F.collect_list("edge")).alias("edges"))


def merge_fold(edges: str, n: str) -> Column:
    """BPE as a fold over merge steps: the state is a long with a bit for each place where a token begins or ends.

    `edges` are sorted by rank, then start. An edge joins two tokens if its ends are set and one place between them is;
    each step takes the first such edge and clears that place. n is at most FOLD_LENGTH.
    """
    start, length = f"cast(shiftright(e, 6) & {MAX_START - 1} as int)", f"cast(e & {MAX_LEN - 1} as int)"
    masks = f"struct(shiftleft(1L, {start}) | shiftleft(1L, {start} + {length}) as ends, shiftleft(shiftleft(1L, {length} - 1) - 1L, {start} + 1) as inner)"
    first = "get(filter(open, e -> (at & e.ends) = e.ends and bit_count(at & e.inner) = 1), 0).inner"
    fold = f"aggregate(sequence(1, least({n} - 1, size({edges}))), shiftleft(1L, {n} + 1) - 1L, (at, step) -> at & ~coalesce({first}, 0L))"
    return F.expr(f"transform(array(transform({edges}, e -> {masks})), open -> {fold})[0]")


def merge_long(n: int, edges: list[int]) -> list[int]:
    """The same for units of any length, with a heap: where the tokens begin and end."""
    ranks = {e % (MAX_START * MAX_LEN): e // (MAX_START * MAX_LEN) for e in edges}
    after, before = list(range(1, n + 2)), list(range(-1, n))
    heap: list[tuple[int, int, int, int]] = []

    def offer(a: int) -> None:
        if 0 <= a < n and (m := after[a]) < n and (b := after[m]) - a < MAX_LEN and (rank := ranks.get(a * MAX_LEN + b - a)) is not None:
            heapq.heappush(heap, (rank, a, m, b))

    for a in range(n):
        offer(a)
    live = [True] * n
    while heap:
        _, a, m, b = heapq.heappop(heap)
        if not live[a] or after[a] != m or m >= n or not live[m] or after[m] != b:
            continue
        live[m], after[a] = False, b
        if b < n:
            before[b] = a
        offer(a)
        offer(before[a])
    ends = [0]
    while ends[-1] < n:
        ends.append(after[ends[-1]])
    return ends


def ids_of(text: str, starts: np.ndarray, word: np.ndarray, pieces: dict[str, int], bytes_at: int | None, unknown: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the tokens that begin at `starts` of a text, and how many each token gives.

    A character without a piece gives the ids of its bytes, or the unknown id, once for neighbours in the same `word`.
    """
    at = starts.tolist()
    tokens = [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)]
    found = list(map(pieces.get, tokens))
    missing = [k for k, i in enumerate(found) if i is None]
    if not missing:
        return np.array(found, np.uint32), np.ones(len(found), np.int64)
    gaps = set(missing)
    own = {k: [bytes_at + x for x in tokens[k].encode("utf-8", "surrogatepass")] if bytes_at is not None else [] if k - 1 in gaps and word[k] == word[k - 1] else [unknown] for k in missing}
    n = np.ones(len(found), np.int64)
    n[missing] = [len(own[k]) for k in missing]
    ends = np.cumsum(n)
    out = np.repeat(np.array([0 if i is None else i for i in found], np.uint32), n)
    for k in missing:
        out[ends[k] - n[k] : ends[k]] = own[k]
    return out, n


def viterbi(edges: Column, n: Column, worst: Column, unknown: int = 0) -> Column:
    """Unigram fold: the ids of the path over `edges` (struct<start,length,id,score>) with the largest sum of scores.

    A higher-order aggregate over the ends 1..n; the state is the best (score, ids) for each end so far. An end that no
    edge reaches is bridged by the unknown id, ten below the worst piece. Of equal sums the larger ids win.
    """
    start = F.array(F.struct(F.lit(0.0).alias("s"), F.expr("cast(array() as array<int>)").alias("ids")))

    def step(best: Column, end: Column) -> Column:
        prior = lambda k: F.element_at(best, (k + 1).cast("int"))
        here = F.filter(edges, lambda e: e["start"] + e["length"] == end)
        paths = F.transform(here, lambda e: F.struct((prior(e["start"])["s"] + e["score"]).alias("s"), F.concat(prior(e["start"])["ids"], F.array(e["id"].cast("int"))).alias("ids")))
        bridge = F.struct((prior(end - 1)["s"] + worst - 10.0).alias("s"), F.concat(prior(end - 1)["ids"], F.array(F.lit(unknown))).alias("ids"))
        return F.concat(best, F.array(F.array_max(F.concat(paths, F.array(bridge)))))

    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda best: F.element_at(best, -1)["ids"])


def _planes(values: np.ndarray) -> bytes:
    """Numbers below 2^32 byte by byte: first all lowest bytes, last all highest, which are mostly zero."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes, at: int, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").ravel()


def _pack(lens: np.ndarray, body: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=LEVEL).compress(len(lens).to_bytes(4, "little") + _planes(lens) + body)


def _unpack(blob: bytes) -> tuple[np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    return _from_planes(raw, 4, n), raw[4 + 4 * n :]


def _pack_words(words: list[bytes]) -> bytes:
    return _pack(np.fromiter(map(len, words), np.uint32, len(words)), b"".join(words))


def _words(blob: bytes) -> list[bytes]:
    lens, body = _unpack(blob)
    ends = np.cumsum(lens, dtype=np.int64).tolist()
    return [body[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def _characters(blob: bytes) -> tuple[str, np.ndarray]:
    """The words of a blob as one text, spaces shown, and where each begins."""
    lens, body = _unpack(blob)
    begins = np.cumsum(lens, dtype=np.int64) - lens
    heads = (np.frombuffer(body, np.uint8) & 0xC0) != 0x80
    return _shown(body), (np.cumsum(heads) - heads)[begins] if len(lens) else begins


def _pack_cuts(lens: np.ndarray, at: np.ndarray, long: dict[int, list[int]]) -> bytes:
    """A bit for each character of some words, one after the other: whether a token begins there.

    `at` has the fold's result for each word, `long` the token ends of those words that have none.
    """
    begins = np.cumsum(lens) - lens
    flags = np.zeros(int(lens.sum()), bool)
    for k in range(1, int(min(lens.max(initial=0), FOLD_LENGTH))):
        own = begins[(lens > k) & (at >> k & 1 > 0)]
        flags[own + k] = True
    for w, ends in long.items():
        flags[begins[w] : begins[w] + lens[w]] = False
        flags[begins[w] + np.array(ends[:-1])] = True
    return zlib.compress(np.packbits(flags).tobytes(), 1)


def _cuts(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(blob), np.uint8), count=n).astype(bool)


CHUNK = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("sums", pa.list_(pa.int64())), ("uses", pa.binary()), ("body", pa.binary())])
ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])


class Units:
    """The documents of a chunk as numbers of its distinct units."""

    def __init__(self):
        self.ids, self.counts, self.sums, self.order, self.held = [], [], [], [], 0
        self.seen: dict[str, int] = defaultdict()
        self.seen.default_factory = self.seen.__len__

    def add(self, doc_id: int | None, raw: bytes, unit: re.Pattern) -> None:
        units = units_of(raw.decode("utf-8", "replace"), unit)
        self.order.append(np.fromiter(map(self.seen.__getitem__, units), np.uint32, len(units)))
        self.ids.append(doc_id)
        self.counts.append(len(units))
        self.sums.append(xxhash.xxh64_intdigest(raw) - (1 << 63))
        self.held += len(raw)

    def rows(self, part: int, chunk: int, buckets: int) -> pa.RecordBatch:
        """A row with the documents (bucket -1), and one for each bucket with its units.

        The units are in order of bucket and bytes, which packs them well. A document gives a unit by its rank by use
        in the chunk, which packs the documents well; `uses` says how often each unit occurs, and so its rank.
        """
        words = [w.encode() for w in self.seen]
        n = len(words)
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int32, n)
        by_bytes = np.array(sorted(range(n), key=words.__getitem__), np.int64)
        order = by_bytes[np.argsort(bucket[by_bytes], kind="stable")]
        index = np.concatenate(self.order) if self.order else np.zeros(0, np.uint32)
        uses = np.bincount(index, minlength=n)[order]
        rank = np.empty(n, np.uint32)
        rank[order[by_use(uses)]] = np.arange(n, dtype=np.uint32)
        edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
        own = [b for b in range(buckets) if edge[b] < edge[b + 1]]
        none, zip_ = [None] * len(own), zstandard.ZstdCompressor(level=LEVEL).compress
        bodies = [zip_(_planes(rank[index])), *(_pack_words([words[i] for i in order[edge[b] : edge[b + 1]]]) for b in own)]
        columns = [[part] * (1 + len(own)), [chunk] * (1 + len(own)), [-1, *own], [self.ids, *none], [self.counts, *none], [self.sums, *none], [zip_(_planes(uses)), *none], bodies]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, CHUNK, strict=True)], schema=CHUNK)


def chunks(docs: DataFrame, pattern: str, keys: list[int], chunk_bytes: int, buckets: int) -> DataFrame:
    """The rows of all chunks. A task's chunks have one `part`, of `keys`; their numbers are random, so a task that runs again writes new ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, part = random.SystemRandom(), keys[TaskContext.get().partitionId() % len(keys)]
        unit, now = re.compile(pattern, re.S), Units()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                now.add(doc_id.as_py(), text.as_py(), unit)
                if now.held > chunk_bytes:
                    yield now.rows(part, rng.getrandbits(62), buckets)
                    now = Units()
                    trim()
        if now.ids:
            yield now.rows(part, rng.getrandbits(62), buckets)
        del now
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(run, from_arrow_schema(CHUNK))


def by_use(uses: np.ndarray) -> np.ndarray:
    return np.argsort(-uses, kind="stable")


def _shown(word: bytes) -> str:
    return word.decode("utf-8", "surrogatepass").replace(" ", SPACE)


def _distinct(blobs) -> list[bytes]:
    return sorted({w for b in blobs for w in _words(b)})


def _by_chunk(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Joined on the bucketing column alone, so that the chunks stay in place; the chunk is compared on top."""
    right = right.select(F.col("part").alias("__p"), F.col("chunk").alias("__c"), column)
    return left.join(right, (F.col("part") == F.col("__p")) & (F.col("chunk") - F.col("__c") == 0), "left").drop("__p", "__c")


def encode(spark: SparkSession, docs: DataFrame, model_path: str = MODEL, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, ids (array<int>), round_trip (whether the ids decode to the text) for each document."""
    model = load(model_path)
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = BUCKETS * tasks
    text_batches(spark)
    written = write_bucketed(spark, chunks(docs, model.unit, bucket_keys(spark, tasks), chunk_bytes, buckets), "units", tasks, ["part"], compression="none")
    kept = written.where("bucket = -1").select("part", "chunk", "doc_ids", "counts", "sums", "uses", "body")
    # dealt once, for both uses: the plan's two exchanges are the same one
    sent = written.where("bucket >= 0").select("part", "chunk", "bucket", "body").repartition(buckets, "bucket")

    def unify(pdf: pd.DataFrame) -> pd.DataFrame:
        words = _distinct(pdf.body)
        return pd.DataFrame({"bucket": pdf.bucket.iloc[0], "num": np.arange(len(words), dtype=np.int32), "word": list(map(_shown, words))})

    # a bucket's edges are many times its words: the buckets stay apart, whatever the words' size suggests
    words = sent.groupBy("bucket").applyInPandas(unify, "bucket int, num int, word string").repartition(buckets, "bucket")
    edges = merges(words, piece_frame(spark, model), model.longest, ["bucket", "num"])
    short = F.col("n") <= FOLD_LENGTH
    folded = edges.select("bucket", "num", F.when(short, merge_fold("edges", "n")).otherwise(0).alias("at"), F.when(~short, F.col("edges")).alias("edges"))

    def answer(fold_pdf: pd.DataFrame, sent_pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(sent_pdf):
            return pd.DataFrame({"part": [], "chunk": [], "bucket": [], "cuts": []}).astype({"part": "int64", "chunk": "int64", "bucket": "int32"})
        blobs = [_words(b) for b in sent_pdf.body]
        words = sorted(set().union(*blobs))
        place = {w: k for k, w in enumerate(words)}
        lens = np.fromiter((len(w.decode()) for w in words), np.int64, len(words))
        at = np.full(len(words), -1)
        at[fold_pdf.num] = fold_pdf["at"]
        edges = {k: e for k, e in zip(fold_pdf.num, fold_pdf.edges, strict=True) if e is not None}
        long = {k: merge_long(int(lens[k]), edges.get(k, [])) for k in np.flatnonzero(lens > FOLD_LENGTH).tolist()}
        cuts = []
        for blob in blobs:
            own = np.fromiter(map(place.__getitem__, blob), np.int64, len(blob))
            cuts.append(_pack_cuts(lens[own], at[own], {i: long[k] for i, k in enumerate(own.tolist()) if k in long} if long else {}))
        return sent_pdf[["part", "chunk", "bucket"]].assign(cuts=cuts)

    answers = folded.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInPandas(answer, "part long, chunk long, bucket int, cuts binary")
    # dealt by the task that wrote the chunk, as its table is: they are grouped and joined where they arrive
    gathered = answers.repartition(tasks, "part").groupBy("part", "chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "cuts"))).alias("cuts"))
    own = written.where("bucket >= 0").groupBy("part", "chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "body"))).alias("words"))
    joined = _by_chunk(_by_chunk(kept, gathered, "cuts"), own, "words")
    table = spark.sparkContext.broadcast(model)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surface = Ragged.of(table.value.surface)
        for batch in batches:
            for row in range(batch.num_rows):
                yield from _documents({c: batch.column(c)[row] for c in batch.schema.names}, table.value, surface)
                trim()

    return joined.mapInArrow(assemble, from_arrow_schema(ENCODED))


@dataclass
class Ragged:
    """Arrays one after the other."""

    flat: np.ndarray
    starts: np.ndarray
    lens: np.ndarray

    @staticmethod
    def of(values: list[bytes]) -> Ragged:
        lens = np.fromiter(map(len, values), np.int64, len(values))
        return Ragged(np.frombuffer(b"".join(values), np.uint8), np.cumsum(lens) - lens, lens)

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows `which`, one after the other, and where each ends."""
        n = self.lens[which]
        ends = np.cumsum(n)
        at = np.repeat(self.starts[which] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.flat[at], ends


def _unit_ids(words, cuts, model: Model) -> Ragged:
    """The ids of a chunk's units, in order of bucket and bytes."""
    flat, lens = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for sent, cut in zip(words or [], cuts or [], strict=True):
        text, begins = _characters(sent["body"])
        first = _cuts(cut["cuts"], len(text))
        first[begins] = True
        tokens = np.flatnonzero(first)
        word = np.searchsorted(begins, tokens, "right") - 1
        ids, n = ids_of(text, tokens, word, model.pieces, model.bytes_at, model.unknown)
        flat.append(ids)
        lens.append(np.bincount(word, n, len(begins)).astype(np.int64))
    flat, lens = np.concatenate(flat), np.concatenate(lens)
    return Ragged(flat, np.cumsum(lens) - lens, lens)


def _documents(row: dict, model: Model, surface: Ragged) -> Iterator[pa.RecordBatch]:
    """A chunk's documents, some at once: ids by unit, then bytes by id, then cut at the documents' ends."""
    unzip = zstandard.ZstdDecompressor().decompress
    ids_by_unit = _unit_ids(row["words"].as_py(), row["cuts"].as_py(), model)
    uses, raw = unzip(row["uses"].as_py()), unzip(row["body"].as_py())
    index = by_use(_from_planes(uses, 0, len(uses) // 4).astype(np.int64)).astype(np.uint32)[_from_planes(raw, 0, len(raw) // 4)]
    doc_ids, sums = row["doc_ids"].values, row["sums"].values.to_numpy()
    units = np.concatenate([[0], np.cumsum(row["counts"].values.to_numpy(), dtype=np.int64)])
    first, n_docs = 0, len(doc_ids)
    while first < n_docs:
        after = max(first + 1, int(np.searchsorted(units, units[first] + GROUP_UNITS, "right")) - 1)
        ids, unit_ends = ids_by_unit.gather(index[units[first] : units[after]])
        text, id_ends = surface.gather(ids)
        last = np.concatenate([[0], unit_ends])[units[first : after + 1] - units[first]]
        ends = np.concatenate([[0], id_ends])[last].tolist()
        view = memoryview(np.ascontiguousarray(text))
        same = [xxhash.xxh64_intdigest(view[a + 1 : b]) - (1 << 63) == s for a, b, s in zip(ends, ends[1:], sums[first:after].tolist(), strict=False)]
        lists = pa.ListArray.from_arrays(pa.array(last, pa.int32()), pa.array(ids.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([doc_ids[first:after], lists, pa.array(same, pa.bool_())], schema=ENCODED)
        first = after


def decode_ids(ids, surface: list[bytes]) -> str:
    text = b"".join(surface[i] for i in ids)
    return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


def decode(spark: SparkSession, encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """`encoded` with the column text from its ids; null ids give null."""
    shared = spark.sparkContext.broadcast(load(model_path).surface)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda ids: None if ids is None else decode_ids(ids, shared.value))

    return encoded.withColumn("text", F.pandas_udf(run, "string")(F.col("ids")))


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), "round_trip")
