"""Line dedup over levelled sorted runs of line hashes.

A run is a written table of (h1, h2, n): the hash of a line's key and a number of documents, bucketed and sorted by
hash, so that runs merge-join without being moved. Documents come in batches. A batch is reduced to its own sorted
keys; a merge-anti-join against every run gives the keys that are new, which become a run of level 0; the batch's other
keys carry their counts on. As soon as a level has FAN_IN runs they are compacted into one run of the next level, and
the carried counts of their keys with them. So a key lies in one run, and the runs grow with the logarithm of the
batches. A key's documents are its run's count and what was carried since.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. A blank line has no key and
is never dropped. Null and empty texts are one empty line. Each row counts as a document of its own, also where rows
or ids repeat or are null; ties don't arise, as a key is common or not. Texts and lines may be of any length, and are
hashed whole. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_shared, write_bucketed, write_shared

WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_DOCS = 10
FAN_IN = 2
BATCHES = 4
#: Keys of a run's bucket, on average, over all runs.
BUCKET_KEYS = 1_000_000
MAX_BUCKETS = 50_000
#: So many common keys at most are broadcast, 16 bytes each.
BROADCAST_KEYS = 500_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(WHITE))
    # the same for ASCII, and much faster than a translation
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def row_keys(text: Column) -> Column:
    """The distinct keys of a text's lines."""
    return F.array_distinct(F.filter(F.transform(lines_of(text), line_key), lambda key: F.length(key) > 0))


def hashes(key: Column) -> list[Column]:
    """128 bits of a key."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")]


class LevelledRuns:
    """The runs; `levels[k]` holds those of level k, `carried` what known keys have gained. The driver holds names only."""

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN, keys: int = 0):
        """`keys`: about how many keys there will be, which sets the number of buckets."""
        self.spark, self.fan_in, self.levels, self.carried = spark, fan_in, [[]], []
        self.buckets = min(MAX_BUCKETS, keys // BUCKET_KEYS + 1)

    @property
    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def write(self, counts: DataFrame, partition_by: str | None = None) -> DataFrame:
        """A run. `flat` reads its files without the buckets: a union of bucketed scans loses rows' places (Spark 4.1)."""
        dealt = counts.repartition(self.buckets, "h1", "h2")
        run = write_bucketed(self.spark, dealt, "run", self.buckets, ["h1", "h2"], ["h1", "h2"], partition_by)
        run.flat = self.spark.read.schema(run.schema).parquet(run.shared_path)
        return run

    def counts(self) -> DataFrame:
        """All keys with their numbers of documents."""
        if not self.runs:
            return self.spark.createDataFrame([], "h1 long, h2 long, n long")
        return _summed([run.flat for run in [*self.runs, *self.carried]])

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Merge-anti-join of sorted keys (h1, h2, ...) against every run."""
        return _without(keys, self.runs)

    def add(self, own: DataFrame) -> None:
        """Adds a batch: `own` has each of its keys once, with the number of its documents, written as a run."""
        if not self.runs:
            self.levels[0].append(own)
            return
        new = self.write(self.unseen(own))
        self.carried.append(self.write(_without(own, [new])))
        self.levels[0].append(new)
        self.compact()

    def compact(self) -> None:
        """Merges the runs of each full level. What was carried for their keys is added to them; the rest is carried on."""
        k = 0
        while k < len(self.levels):
            if len(self.levels[k]) >= self.fan_in:
                runs, self.levels[k], gained = self.levels[k], [], self.carried
                flat, more = [r.flat for r in runs], _summed([c.flat for c in gained])
                merged = self.write(_summed([*flat, more.join(_union(flat).select("h1", "h2"), ["h1", "h2"], "left_semi")]))
                self.carried = [self.write(_without(more, runs))] if self.runs else []
                for old in [*runs, *gained]:
                    drop_shared(self.spark, old)
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(merged)
            k += 1


def _without(keys: DataFrame, runs: list[DataFrame]) -> DataFrame:
    for run in runs:
        keys = keys.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
    return keys


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _summed(frames: list[DataFrame]) -> DataFrame:
    return _union([f.select("h1", "h2", "n") for f in frames]).groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def line_keys(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, t, batch, h1, h2: the distinct keys of each row. `t` stands for the text; rows that agree in both have the same lines."""
    row = docs.select("doc_id", F.xxhash64("text").alias("t"), F.explode(row_keys(F.col("text"))).alias("key"))
    return row.select("doc_id", "t", F.pmod(F.xxhash64("doc_id", "t"), F.lit(batches)).cast("int").alias("batch"), *hashes(F.col("key")))


def batch_counts(keys: DataFrame) -> DataFrame:
    """Each batch's keys with the number of the batch's documents that have them."""
    return keys.groupBy("h1", "h2", "batch").agg(F.count("*").alias("n"))


def build_runs(spark: SparkSession, keys: DataFrame, batches: int = BATCHES, fan_in: int = FAN_IN) -> LevelledRuns:
    """The runs after all batches. The batches' own sorted keys are written in one pass, and added one batch after the other."""
    runs = LevelledRuns(spark, fan_in, keys.count())
    own = runs.write(batch_counts(keys), partition_by="batch")
    for b in range(batches):
        batch = own.where(F.col("batch") == b).select("h1", "h2", "n")
        batch.flat = own.flat.where(F.col("batch") == b).select("h1", "h2", "n")
        runs.add(batch)
    return runs


def dropped_keys(keys: DataFrame, common: DataFrame) -> DataFrame:
    """doc_id, t with the hashes of the row's lines that are in `common`; rows without any are absent."""
    hit = keys.join(common, ["h1", "h2"], "left_semi")
    return hit.groupBy("doc_id", "t").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))


def dedup_lines(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, fan_in: int = FAN_IN) -> DataFrame:
    """docs with the columns __lines and __kept: every line, and those whose key is in fewer than `min_docs` rows."""
    keys = write_shared(spark, line_keys(docs.select("doc_id", "text"), batches), "keys")
    runs = build_runs(spark, keys, batches, fan_in)
    # written, so that its size is known, and a join on a hot key can be split
    common = write_shared(spark, runs.counts().where(F.col("n") >= min_docs).select("h1", "h2"), "common")
    common = F.broadcast(common) if common.count() <= BROADCAST_KEYS else common
    gone = dropped_keys(keys, common).select(F.col("doc_id").alias("__d"), F.col("t").alias("__t"), F.col("gone").alias("__gone"))
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone["__d"]) & (F.xxhash64(docs["text"]) == gone["__t"]), "left")
    pairs = F.transform(F.transform("__lines", lambda x: F.struct(x.alias("line"), line_key(x).alias("key"))), lambda x: F.struct(x["line"].alias("line"), F.struct(*hashes(x["key"])).alias("hash"), (F.length(x["key"]) > 0).alias("full")))
    kept = F.transform(F.filter(pairs, lambda x: ~(x["full"] & F.array_contains(F.col("__gone"), x["hash"]))), lambda x: x["line"])
    keep = F.when(F.col("__gone").isNull(), F.col("__lines")).otherwise(kept)
    return joined.withColumn("__lines", lines_of(docs["text"])).withColumn("__kept", keep).drop("__d", "__t", "__gone")


def digest(done: DataFrame) -> DataFrame:
    return done.select(
        "doc_id",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size("__kept")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("__kept", "\n").cast("binary"), 256).alias("kept_sha256"),
    )


def drop_common_lines(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents without their common lines; columns stay. A document that loses all its lines keeps an empty text."""
    done = dedup_lines(spark, docs, min_docs)
    return done.withColumn("text", F.when(F.size("__kept") < F.size("__lines"), F.array_join("__kept", "\n")).otherwise(F.col("text"))).select(*docs.columns)
