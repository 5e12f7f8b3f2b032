"""Embedding near-duplicates by collision counting on one-dimensional projections.

Unit vectors with cosine c are sqrt(2 - 2c) = R apart. On orthonormal projections the squared differences of a pair
sum to at most R^2, so with windows of half-width w = R / sqrt(MISSES + 1) around each query at most MISSES of M
projections can miss: a linked pair always collides in M - MISSES. That count is the calibrated one, and its recall is
1 by construction; pairs that reach it are verified by cosine in double precision.

Equal vectors of a label are one node with a weight and a number of its own. The first projection is cut into cells of
width R, so a link lies in one cell or two adjacent ones; a cell of more than BLOCK_BYTES is cut into blocks by hash, and
every pair of blocks that may hold a link is one task group, of two blocks at most. In a group the projections of one
block are sorted, and each query of the other counts the collisions in its windows. The group returns link counts and a
spanning forest.

Within one label the work is quadratic in the vectors that share a cell: unit vectors of many dimensions without
clusters lie within R of each other on any few axes, so a grid on more of them prunes no better. What grows with it is
bounded by the block: each vector is sent once for each block in reach, 2 * cell bytes / BLOCK_BYTES times.

Null, empty and zero vectors, and those with null or non-finite components, link with nothing, as do vectors without
label, of other labels or other lengths. Rows with a null vec_id are counted as links of others, but have none
reported. Repeated rows are vectors of their own, and ties at the threshold are links. A vector may have any length; a
block has one vector at least. Only vec_id, embedding and label are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import number_batches, write_shared
from .components import connected_components

COSINE = 0.93
#: Bytes of the vectors of a block, as they are sent.
BLOCK_BYTES = 4 << 20
#: A plan of so many cells at most is broadcast, some 60 bytes each.
PLAN_ROWS = 200_000
PROJECTIONS = 32
SEED = 20260101


def rotation(dim: int) -> np.ndarray:
    """The first PROJECTIONS rows of a fixed random orthonormal basis."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).normal(size=(dim, dim)))
    return (q * np.sign(np.diag(r))).T[: min(dim, PROJECTIONS)]


def calibrated(dim: int, cosine: float) -> tuple[float, int]:
    """Half-width of a window, and the collisions that every linked pair reaches."""
    m = min(dim, PROJECTIONS)
    misses = m // 4
    return float(np.sqrt((2 - 2 * cosine) / (misses + 1))) + 1e-6, m - misses


def collisions(own: np.ndarray, queries: np.ndarray, width: float, need: int):
    """For each query the rows of `own` whose projections fall into at least `need` of its windows."""
    m, n = own.shape[1], len(own)
    order = np.argsort(own, axis=0, kind="stable")
    lo = np.empty((len(queries), m), np.int64)
    hi = np.empty((len(queries), m), np.int64)
    for j in range(m):
        column = own[order[:, j], j]
        lo[:, j] = np.searchsorted(column, queries[:, j] - width, "left")
        hi[:, j] = np.searchsorted(column, queries[:, j] + width, "right")
    columns = [np.ascontiguousarray(order[:, j]) for j in range(m)]
    for q in range(len(queries)):
        found = np.bincount(np.concatenate([c[a:b] for c, a, b in zip(columns, lo[q], hi[q], strict=True)]), minlength=n)
        if len(near := np.flatnonzero(found >= need)):
            yield q, near


def block_links(ids: np.ndarray, weights: np.ndarray, vectors: np.ndarray, first: np.ndarray, second: np.ndarray, cosine: float):
    """Links between the rows `first` and `second` (equal: within it): weight linked to each row, and a forest."""
    norms = np.sqrt((vectors * vectors).sum(1))
    proj = (vectors / norms[:, None]) @ rotation(vectors.shape[1]).T
    width, need = calibrated(vectors.shape[1], cosine)
    same = first is second
    degree = np.zeros(len(ids), np.int64)
    label, forest = np.arange(len(ids)), []
    for q, near in collisions(proj[first], proj[second], width, need):
        x, others = second[q], first[near]
        if same:
            others = others[others > x]
        linked = others[(vectors[others] @ vectors[x]) / (norms[others] * norms[x]) >= cosine]
        if not len(linked):
            continue
        degree[x] += weights[linked].sum()
        degree[linked] += weights[x]
        strange = linked[label[linked] != label[x]]
        while len(strange):
            y = strange[0]
            forest.append((ids[x], ids[y]))
            label[label == label[y]] = label[x]
            strange = strange[label[strange] != label[x]]
    return degree, forest


def near_duplicates(spark: SparkSession, rows: DataFrame, cosine: float = COSINE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row."""
    radius = float(np.sqrt(2 - 2 * cosine)) + 1e-6
    single = rows.schema["embedding"].dataType.simpleString() == "array<float>"
    number, wire = ("float", np.float32) if single else ("double", np.float64)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{number}>").alias("v"), F.col("label"))
    sound = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    key = [F.xxhash64("label", "v").alias("h1"), F.xxhash64(F.lit(1), "v", "label").alias("h2")]
    nodes = rows.where(sound).groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))

    def project(batches):
        for batch in batches:
            out = np.empty(len(batch))
            dims = batch.v.map(len).to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = np.stack(batch.v.iloc[at].to_numpy()).astype(np.float64)
                x /= np.abs(x).max(1, keepdims=True)
                out[at] = (x / np.sqrt((x * x).sum(1))[:, None]) @ rotation(int(d))[0]
            yield batch[["label", "least", "n", "h1", "h2", "node"]].assign(vec=[np.asarray(v, wire).tobytes() for v in batch.v], dim=dims, cell=np.floor(out / radius).astype(np.int32))

    # the numbers are part of the written table, so they stay
    keyed = nodes.select("label", "v", "least", "n", *key, F.monotonically_increasing_id().alias("node"))
    label_type = rows.schema["label"].dataType.simpleString()
    with number_batches(spark):
        cells = write_shared(spark, keyed.mapInPandas(project, f"label {label_type}, least long, n long, h1 long, h2 long, node long, vec binary, dim int, cell int"), "projections")

    place = ["label", "dim", "cell"]
    sizes = cells.groupBy(*place).agg(F.ceil(F.sum(F.octet_length("vec")) / block_bytes).cast("int").alias("blocks"))
    above = sizes.select("label", "dim", (F.col("cell") - 1).alias("cell"), F.col("blocks").alias("over"))
    below = sizes.select("label", "dim", (F.col("cell") + 1).alias("cell"), F.col("blocks").alias("under"))
    plan = write_shared(spark, sizes.join(above, place, "left").join(below, place, "left"), "plan")
    plan = F.broadcast(plan) if plan.count() <= PLAN_ROWS else plan
    dealt = cells.join(plan, place).withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks")).cast("int"))
    numbers = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    target = lambda low, step, a, b, side: F.struct(low.cast("int").alias("low"), F.lit(step).alias("step"), a.cast("int").alias("a"), b.cast("int").alias("b"), side.cast("int").alias("side"))
    block = F.col("block")
    to = F.concat(
        F.transform(numbers(F.col("blocks")), lambda o: target(F.col("cell"), 0, F.least(block, o), F.greatest(block, o), F.when(block <= o, 0).otherwise(1))),
        F.transform(numbers(F.col("over")), lambda o: target(F.col("cell"), 1, block, o, F.lit(0))),
        F.transform(numbers(F.col("under")), lambda o: target(F.col("cell") - 1, 1, o, block, F.lit(1))),
    )
    groups = dealt.withColumn("to", F.explode(to)).select("label", "dim", "to.low", "to.step", "to.a", "to.b", "to.side", "node", "n", "vec")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors = np.frombuffer(b"".join(pdf.vec), wire).astype(np.float64).reshape(len(pdf), -1)
        vectors = vectors / np.abs(vectors).max(1, keepdims=True)  # no overflow in the norms; cosines stay
        ids, weights, side = pdf.node.to_numpy(), pdf.n.to_numpy(), pdf.side.to_numpy()
        within = pdf.step.iloc[0] == 0 and pdf.a.iloc[0] == pdf.b.iloc[0]
        first = np.arange(len(pdf)) if within else np.flatnonzero(side == 0)
        second = first if within else np.flatnonzero(side == 1)
        degree, forest = block_links(ids, weights, vectors, first, second, cosine) if len(first) and len(second) else (np.zeros(len(ids), np.int64), [])
        some = np.flatnonzero(degree)
        links = pd.DataFrame({"a": ids[some], "b": ids[some], "n": degree[some]})
        return pd.concat([links, pd.DataFrame(forest, columns=["a", "b"], dtype=np.int64).assign(n=0)], ignore_index=True).astype("int64")

    with number_batches(spark):
        found = write_shared(spark, groups.groupBy("label", "dim", "low", "step", "a", "b").applyInPandas(compare, "a long, b long, n long"), "links")
    degrees = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    tied = connected_components(spark, found.where("n = 0").select("a", "b"))
    rooted = cells.select("node", "h1", "h2", "least", "n").join(tied, "node", "left").select("node", "h1", "h2", "least", "n", F.coalesce("root", "node").alias("root"))
    # written, so that the join on a large component's root can be split
    least = write_shared(spark, rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    done = rooted.join(least, "root").join(degrees, "node", "left").select("h1", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    usable = sound & F.col("vec_id").isNotNull()
    out = rows.select("vec_id", *(F.when(usable, h).alias(name) for h, name in zip(key, ("h1", "h2"), strict=True))).join(done, ["h1", "h2"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
