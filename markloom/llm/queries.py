"""Queries over the corpus operators, each over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embeddings, license, lines, pieces, pii, sharding, simhash, suffixes, toxicity, xxh64
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.digest(license.scan(spark, table(spark, sf_dir, "documents")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.dedup_lines(spark, table(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.assign(spark, table(spark, sf_dir, "documents")))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(pieces.encode(spark, table(spark, sf_dir, "documents")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.remove_repeats(spark, table(spark, sf_dir, "documents")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(spark, table(spark, sf_dir, "documents")))


def sharding_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards with their rows and slots."""
    placed = sharding.assign(spark, table(spark, sf_dir, "documents"))
    return placed.groupBy(F.col("shard").cast("int").alias("shard")).agg(F.count("*").alias("n"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count_distinct("slot").alias("n_slots"))


def sharding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after the exchange: all of them, with their texts."""
    moved = sharding.shuffled(spark, table(spark, sf_dir, "documents"))
    return moved.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "lang", "source")


def pii_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts after pseudonyms are put in and taken out again."""
    there = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("__text").alias("text"))
    return pii.pseudonymise(there, undo=True).select("doc_id", F.sha2(F.col("__text").cast("binary"), 256).alias("text_sha256"))


def pieces_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that the ids decode to."""
    back = pieces.decode(spark, pieces.encode(spark, table(spark, sf_dir, "documents")))
    return back.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def pieces_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best path by score of every distinct word of the benchmark."""
    split = F.explode(F.split(F.coalesce("text", F.lit("")), r"[\s]+", -1))
    words = table(spark, sf_dir, "benchmark").select(split.alias("w")).where("w <> ''").distinct().select("w", F.concat(F.lit(" "), "w").alias("word"))
    return pieces.best_paths(spark, words, ["w"]).select("w", F.size("path").alias("n"), F.array_join("path", ",").alias("path"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BITS = ", ".join(f"CASE WHEN 2 * count(*) FILTER ((h >> {b}) & 1 = 1) > count(*) THEN CAST({1 << b} AS UBIGINT) ELSE CAST(0 AS UBIGINT) END AS b{b}" for b in range(64))
_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        p AS (SELECT item_id, CAST(least(10, len(w)) AS BIGINT) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i : i + least(10, len(w)) - 1], ' '))) AS gram FROM b WHERE len(w) > 0),
        g AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS gram FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n),
        h AS (SELECT g.doc_id, g.i, g.n, p.item_id FROM g JOIN p ON g.n = p.n AND g.gram = p.gram),
        c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY 1),
        t AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM h GROUP BY 1)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op3_line_dedup": f"""
        WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM s),
        k AS (SELECT *, {_LOWER.format(f"trim(line, {_WHITE})")} AS key FROM l),
        c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN c USING (key) GROUP BY doc_id""",
    "op9_suffix_dedup": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        p AS (SELECT r, unnest(range(1, CAST(length(h) / 2 AS BIGINT) - 198)) AS i FROM d WHERE length(h) >= 400),
        g AS (SELECT r, i, md5(substr(h, CAST(2 * i - 1 AS BIGINT), 400)) AS k FROM p JOIN d USING (r)),
        s AS (SELECT r, i FROM g JOIN (SELECT k FROM g GROUP BY k HAVING count(*) > 1) USING (k)),
        f AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM s),
        n AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS span FROM f),
        c AS (SELECT r, span, min(i) AS a, max(i) + 199 AS b FROM n GROUP BY r, span),
        k AS (SELECT r, b + 1 AS a, coalesce(lead(a) OVER (PARTITION BY r ORDER BY a) - 1, 1000000000) AS b FROM (SELECT r, a, b FROM c UNION ALL SELECT r, 0, 0 FROM d)),
        t AS (SELECT r, string_agg(substr(h, CAST(2 * k.a - 1 AS BIGINT), CAST(2 * greatest(k.b - k.a + 1, 0) AS BIGINT)), '' ORDER BY k.a) AS kept FROM k JOIN d USING (r) GROUP BY r)
        SELECT doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
        FROM d JOIN t USING (r) LEFT JOIN (SELECT r, sum(b - a + 1) AS removed, count(*) AS spans FROM c GROUP BY r) USING (r)""",
    "op10_simhash": f"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT r, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i : i + 3], ' '))) AS g FROM d WHERE len(w) > 0),
        u AS (SELECT DISTINCT g FROM s),
        {xxh64.ctes("u", simhash.SEED)},
        c AS (SELECT r, {_BITS} FROM s JOIN xxh64 USING (g) GROUP BY r),
        p AS (SELECT d.r, doc_id, coalesce({" | ".join(f"b{b}" for b in range(64))}, CAST(0 AS UBIGINT)) AS fp FROM d LEFT JOIN c USING (r)),
        n AS (SELECT DISTINCT fp FROM p), e AS (SELECT a.fp AS x, b.fp AS y FROM n a JOIN n b ON a.fp <> b.fp AND bit_count(CAST(xor(a.fp, b.fp) AS BIT)) <= 4),
        reach(fp, o) AS (SELECT fp, fp FROM n UNION SELECT e.y, reach.o FROM reach JOIN e ON e.x = reach.fp),
        m AS (SELECT reach.o AS fp, min(doc_id) AS component_id FROM reach JOIN p USING (fp) GROUP BY reach.o)
        SELECT doc_id, printf('%016x', fp) AS fingerprint, component_id FROM p JOIN m USING (fp)""",
    "sharding_shards": """
        WITH n AS (SELECT count(*) AS n FROM documents), s AS (SELECT CAST(i AS INTEGER) AS shard, n // 24 + CASE WHEN i < n % 24 THEN 1 ELSE 0 END AS n FROM n, range(24) t(i))
        SELECT shard, n, 0 AS first_slot, n - 1 AS last_slot, n AS n_slots FROM s WHERE n > 0""",
    "sharding_texts": "SELECT doc_id, sha256(text) AS text_sha256, lang, source FROM documents",
    "pii_round_trip": "SELECT doc_id, sha256(text) AS text_sha256 FROM documents",
    "pieces_round_trip": "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
    "op5_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        pair AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
        reach(id, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT pair.v, reach.r FROM reach JOIN pair ON pair.u = reach.id),
        c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id), n AS (SELECT u, count(*) AS n FROM pair GROUP BY u)
        SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM c LEFT JOIN n ON n.u = c.id""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontaminate, op2_license, op3_line_dedup, op4_toxicity, op5_embedding_dedup, op6_sharding, op7_pieces, op8_pii, op9_suffix_dedup, op10_simhash, sharding_shards, sharding_texts, pii_round_trip, pieces_round_trip, pieces_viterbi)}
