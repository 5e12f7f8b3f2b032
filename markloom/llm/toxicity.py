"""Toxicity by weak supervision.

Voters: a general insult lexicon, words and word beginnings that the labelled rows single out, patterns of insult, and
two that vote for clean; where there is a label, it is one more voter. Each says toxic, clean or nothing. A generative
label model (one hidden class) is fitted by expectation maximisation on the votes of labelled and unlabelled learning
rows: how often each voter says what in either class, so its accuracy, and for the pairs that stay most correlated within
the classes, how often they say what together. These pairs form a forest, so the model stays exact. A linear classifier
over the voters' counts is then trained on the posterior labels and gives the score.

Learning sees only rows whose crc32(doc_id) mod 4 is not 2, and of them the LEARN_ROWS ids with the smallest hash among
the labelled ones, and a third as many among the others, each up to LEARN_BYTES of text: a fixed bound in rows and bytes.
VOTERS and MIN_TOXIC_DOCS bound the learned voters: the best VOTERS words and beginnings each, that MIN_TOXIC_DOCS toxic
rows have. An id that is labelled twice is toxic if any label says so; of rows with one id, the one with the smallest
text hash is learned from. Labels, lang, source and doc_id are no inputs of a score, and rows are scored one by one:
repeated and null ids need no rule. Null and empty texts get the score of a text without any vote; a text of any length
is read whole. Without labelled rows the lexicon alone votes. A score of exactly THRESHOLD is rejected.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_batches, text_bytes

LEARN_ROWS = 6_000
LEARN_BYTES = 48 << 20
HELD_OUT = (4, 2)  # crc32(doc_id) mod 4 == 2
THRESHOLD = 0.3
VOTERS = 200
STEMS = (4, 5, 6)
#: Toxic learning rows that a learned voter occurs in, at least.
MIN_TOXIC_DOCS = 4
#: Correlation within the classes from which a pair of voters is modelled as such.
CORRELATED = 0.2
LABEL_RIGHT = 0.97

#: A general lexicon.
LEXICON = {
    "mind": "idiot idiots moron morons stupid dumb dimwit imbecile fool fools cretin halfwit",
    "worth": "worthless loser losers pathetic useless nobody failure garbage trash",
    "contempt": "scum clown clowns disgusting filthy vermin parasite pig swine rat creep",
    "abuse": "bastard bitch asshole whore slut crap shit fuck fucking damn bullshit",
    "threat": "kill die hurt destroy punch strangle hang shoot",
}
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


#: Pattern voters: the name, and what of a text with `hits` words of the lexicon counts.
PATTERNS = {
    "shouting": lambda text, hits: len(SHOUT.findall(text)) if "!!" in text else 0,
    "addressed": lambda text, hits: len(ADDRESS.findall(text)) if hits else 0,
    "exclaimed": lambda text, hits: len(EXCLAIM.findall(text)) if hits else 0,
    "several": lambda text, hits: max(0, hits - 1),
    "dense": lambda text, hits: 100 * hits // (1 + text.count(" ")),
}
SHOUT = re.compile(r"[A-Z]{4,}!{2,}")
_INSULT = "|".join(sorted({w for group in LEXICON.values() for w in group.split()}))
ADDRESS = re.compile(rf"(?i)\b(?:you|your|du|ihr|tu|vous|t[uú]|usted)\b[^.!?\n]{{0,30}}\b(?:{_INSULT})\b")
EXCLAIM = re.compile(rf"(?i)\b(?:{_INSULT})\b\W{{0,2}}!")


@dataclass
class Model:
    """Features: exact words, word beginnings and patterns, each with a weight on log1p(count)."""

    words: dict[str, int] = field(default_factory=dict)
    stems: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    plain: set[int] = field(default_factory=set)  # the features of the lexicon
    heads: frozenset[str] = frozenset()

    @property
    def n_words(self) -> int:
        return len(self.words) + len(self.stems)

    def counts(self, text: str) -> dict[int, int]:
        """How often each feature occurs, without those that don't."""
        if not self.heads:
            self.heads = frozenset(key[: STEMS[0]] for key in (*self.words, *self.stems))
        heads, least, found = self.heads, STEMS[0], {}
        for word, n in [x for x in Counter(WORD.findall(text.lower())).items() if x[0][:least] in heads]:
            for k in (self.words.get(word), *(self.stems.get(word[:size]) for size in STEMS if len(word) > size)):
                if k is not None:
                    found[k] = found.get(k, 0) + n
        hits = sum(n for k, n in found.items() if k in self.plain)
        for k, pattern in enumerate(PATTERNS.values(), self.n_words):
            if n := pattern(text, hits):
                found[k] = n
        return found

    def score(self, text: str | None) -> float:
        z = self.bias + sum(float(self.weights[k]) * math.log1p(n) for k, n in self.counts(text or "").items())
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def without_copies(texts: list[str], known: np.ndarray) -> np.ndarray:
    """The labelled rows without near copies: of those with one label whose five-word shingles share their least hash, the first."""
    seen, out = set(), []
    for i in np.flatnonzero(known >= 0).tolist():
        words = texts[i].lower().split()
        least = min((zlib.crc32(" ".join(words[k : k + 5]).encode("utf-8", "replace")) for k in range(max(1, len(words) - 4))), default=0)
        if (known[i], least) not in seen:
            seen.add((known[i], least))
            out.append(i)
    return np.array(out, int)


def candidates(texts: list[str], toxic: np.ndarray) -> tuple[list[str], list[str]]:
    """Beginnings and words that are far more frequent in toxic rows than in clean ones, and not by chance.

    MIN_TOXIC_DOCS toxic rows at least have them, and nine times as many as clean ones. Chance is bounded (Chernoff) for
    as many words as were looked at, so that none is expected to pass by it.
    """
    of: dict[int, dict[str, Counter]] = {c: {"w": Counter(), "s": Counter()} for c in (0, 1)}
    looked_at = {}
    for label in (1, 0):  # of the clean rows only what toxic ones have often enough is counted
        for text in (t for t, k in zip(texts, toxic, strict=True) if k == label):
            words = set(words_of(text))
            keys = {"w": words, "s": {w[:n] for w in words for n in STEMS if len(w) > n}}
            for kind, own in keys.items():
                of[label][kind].update(own if label else own & of[1][kind].keys())
        if label:
            looked_at = {kind: len(counts) for kind, counts in of[1].items()}
            of[1] = {kind: Counter({k: n for k, n in counts.items() if n >= MIN_TOXIC_DOCS}) for kind, counts in of[1].items()}
    share = float(np.clip((toxic == 1).mean(), 1e-3, 1 - 1e-3))
    out = []
    for kind in ("s", "w"):
        rated, looked = [], math.log(20 * max(1, looked_at[kind]))
        for key, k1 in of[1][kind].items():
            k0 = of[0][kind][key]
            if k1 >= 9 * k0:
                q = k1 / (k0 + k1)
                surprise = k1 * math.log(q / share) + (k0 * math.log((1 - q) / (1 - share)) if k0 else 0)
                if surprise >= looked:
                    rated.append((-surprise, key))
        out.append([key for _, key in sorted(rated)[:VOTERS]])
    return out[0], out[1]


def fitting(lexicon: list[str], texts: list[str], known: np.ndarray) -> list[str]:
    """The words of the lexicon without those that labelled clean rows have about as often (in another language, say)."""
    of = {c: Counter() for c in (0, 1)}
    wanted = set(lexicon)
    for text, label in zip(texts, known, strict=True):
        if label >= 0:
            of[int(label)].update(wanted.intersection(words_of(text)))
    n1, n0 = (known == 1).sum() + 1, (known == 0).sum() + 1
    return [w for w in lexicon if of[0][w] <= 2 or of[1][w] / n1 >= 8 * of[0][w] / n0]


def forest(correlation: np.ndarray, least: float = CORRELATED) -> list[tuple[int, int]]:
    """The pairs with the largest correlations that make no circle (a maximum spanning forest)."""
    m = len(correlation)
    first, second = np.triu_indices(m, 1)
    strong = np.flatnonzero(correlation[first, second] >= least)
    strong = strong[np.argsort(-correlation[first, second][strong], kind="stable")]
    root, out = list(range(m)), []
    for i, j in zip(first[strong].tolist(), second[strong].tolist(), strict=True):
        a, b = root[i], root[j]
        if a != b:
            root = [a if r == b else r for r in root]
            out.append((i, j))
    return out


def _shares(codes: np.ndarray, n_codes: int, post: np.ndarray, believed: np.ndarray | None = None) -> np.ndarray:
    """For each column the logarithms of its codes' shares in class 0 and class 1, smoothed: (column, code, class).

    `believed` are counts of the last column's codes in either class, on top of those seen.
    """
    m = codes.shape[1]
    flat = (codes + np.arange(m) * n_codes).ravel()
    out = np.empty((m, n_codes, 2))
    for c, weight in enumerate((1 - post, post)):
        counts = np.bincount(flat, np.repeat(weight, m), m * n_codes).reshape(m, n_codes) + 0.3 / n_codes
        counts[-1:] += 0 if believed is None else believed[c]
        out[:, :, c] = np.log(counts / counts.sum(1, keepdims=True))
    return out


def label_model(votes: np.ndarray, prior: float, start: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Posterior of class 1 of each row, the voters' shares of clean, nothing and toxic in either class, and the pairs.

    `votes` is -1, 0 or 1 by row and voter; `start` is the first guess of the posterior. The M step takes the shares,
    the E step the posterior. The pairs are those that agree beyond the classes of the first guess; a pair's evidence is
    that of both votes together. The last voter is the label: it is believed to be right
    LABEL_RIGHT of the time as if that many rows more had shown it, so the hidden class stays the labels' one, but a
    label that all voters contradict is overruled.
    """
    n, m = votes.shape
    told = float((votes[:, -1] != 0).sum())
    believed = told * np.array([[(1 - prior) * LABEL_RIGHT, 0, (1 - prior) * (1 - LABEL_RIGHT)], [prior * (1 - LABEL_RIGHT), 0, prior * LABEL_RIGHT]])
    codes, post, pairs = (votes + 1).astype(np.int64), start.astype(float), []
    joint = np.zeros((n, 0), np.int64)
    rows = np.arange(m)
    for turn in range(rounds):
        single = _shares(codes, 3, post, believed)
        if turn == 0:
            # given the labels, where there are enough of them
            seen = votes[:, -1] != 0 if told >= 50 else np.ones(n, bool)
            own, one = votes[seen, :-1].astype(float), post[seen, None]
            centred = own - one * (one.T @ own) / max(one.sum(), 1e-9) - (1 - one) * ((1 - one).T @ own) / max((1 - one).sum(), 1e-9)
            sd = np.sqrt((centred**2).mean(0)) + 1e-9
            pairs = forest((centred.T @ centred) / len(own) / np.outer(sd, sd))
            joint = np.stack([3 * codes[:, i] + codes[:, j] for i, j in pairs], 1) if pairs else joint
        seen = single[rows, codes]
        log = math.log(prior / (1 - prior)) + (seen[:, :, 1] - seen[:, :, 0]).sum(1)
        if pairs:
            both = _shares(joint, 9, post)[np.arange(len(pairs)), joint]
            alone = np.array(pairs).T
            log += (both[:, :, 1] - both[:, :, 0]).sum(1) - sum((seen[:, k, 1] - seen[:, k, 0]).sum(1) for k in alone)
        post = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
    return post, np.exp(_shares(codes, 3, post, believed)), pairs


def votes_of(x: np.ndarray, n_words: int, lengths: np.ndarray, known: np.ndarray) -> np.ndarray:
    """What each voter says of each row: the features that occur say toxic; a text without any says clean, and once more if it is long; a label says itself."""
    quiet = (x[:, :n_words] == 0).all(1)
    calm, long = -(quiet & (lengths >= 8)).astype(np.int8), -(quiet & (lengths >= 60)).astype(np.int8)
    label = np.where(known < 0, 0, 2 * known - 1).astype(np.int8)
    return np.column_stack([(x > 0).astype(np.int8), calm, long, label])


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.002, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias that fit soft labels, by accelerated gradient steps; a scarce class weighs a quarter in all at least."""
    n, m = x.shape
    share = float(np.clip((y >= 0.5).mean(), 1 / n, 1 - 1 / n))
    weight = np.where(y >= 0.5, max(share, 0.25) / share, min(1 - share, 0.75) / (1 - share))
    a = np.hstack([x, np.ones((n, 1))])
    w = v = np.zeros(m + 1)
    lip = 0.25 * np.linalg.norm((np.sqrt(weight)[:, None] * a), 2) ** 2 / n + l2
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ v, -30, 30)))
        grad = a.T @ (weight * (p - y)) / n + l2 * np.append(v[:-1], 0)
        fresh = v - grad / lip
        v = fresh + t / (t + 3) * (fresh - w)
        w = fresh
    return w[:-1], float(w[-1])


def train(texts: list[str], known: np.ndarray) -> Model:
    model = Model()
    lexicon = sorted({w for group in LEXICON.values() for w in group.split()})
    labelled = known >= 0
    told = without_copies(texts, known)
    stems, words = candidates([texts[i] for i in told], known[told]) if (known[told] == 1).any() else ([], [])
    general = fitting(lexicon, [texts[i] for i in told], known[told])
    for key in dict.fromkeys([*words, *general]):
        model.words[key] = len(model.words)
    model.plain = {model.words[key] for key in general}
    for key in stems:
        model.stems[key] = len(model.words) + len(model.stems)
    m = model.n_words + len(PATTERNS)
    x, lengths = np.zeros((len(texts), m)), np.zeros(len(texts))
    for i, text in enumerate(texts):
        lengths[i] = text.count(" ") + 1
        for k, n in model.counts(text).items():
            x[i, k] = math.log1p(n)
    prior = float(np.clip((known == 1).sum() / max(1, labelled.sum()), 0.005, 0.5)) if labelled.any() else 0.05
    guess = np.where(labelled, np.where(known == 1, 0.95, 0.05), np.where((x > 0).sum(1) >= 2, 0.9, prior * 0.2))
    post = label_model(votes_of(x, model.n_words, lengths, known), prior, guess)[0] if texts else np.zeros(0)
    if not (post >= 0.5).any():
        model.weights, model.bias = np.concatenate([np.full(model.n_words, 2.0), np.zeros(len(PATTERNS))]), -3.0
        return model
    model.weights, model.bias = logistic(x, post)
    model.bias += math.log(THRESHOLD / (1 - THRESHOLD)) - best_cut(x @ model.weights + model.bias, post >= 0.5)
    return model


def best_cut(z: np.ndarray, positive: np.ndarray) -> float:
    """Where the raw score parts the posterior labels: of the cuts with about the fewest errors, the middle of the widest gap."""
    order = np.argsort(z, kind="stable")
    z, positive = z[order], positive[order]
    errors = np.cumsum(positive) + (~positive).sum() - np.cumsum(~positive)  # with the cut right after each row
    gap = np.append(np.diff(z), 1e-6)
    errors = np.where(gap > 1e-9, errors, 2 * len(z))
    at = int(np.argmax(np.where(errors <= 1.1 * errors.min() + 1, gap, 0)))
    return float(z[at] + gap[at] / 2)


def learning_rows(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS, most_bytes: int = LEARN_BYTES) -> tuple[list[str], np.ndarray]:
    """The bounded learning sample: labelled rows, and a third as many without a label, in order of the id's hash.

    An id is one row. Ids whose text would exceed `most_bytes` in all are passed over; a share of it is for each kind.
    """
    mod, left = HELD_OUT
    allowed = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod != left)
    one = labels.where(allowed & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = F.xxhash64(F.lit("learn"), "doc_id")
    thin = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    others = thin.select("doc_id").where(allowed).join(one, "doc_id", "left_anti").distinct()
    chosen = one.orderBy(pick, "doc_id").limit(rows).select("doc_id", F.col("toxic").cast("int").alias("known"))
    chosen = chosen.unionByName(others.orderBy(pick, "doc_id").limit(rows // 3).select("doc_id", F.lit(-1).alias("known")))
    # one text of each id, and its length first: no more than `rows` numbers come to the driver
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), F.octet_length("text").alias("size")))
    sizes = thin.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "known").agg(first.alias("t")).select("doc_id", "known", "t.*", pick.alias("pick")).orderBy("pick", "doc_id").collect()
    held, fits = {True: 0, False: 0}, []
    for r in sizes:
        share = most_bytes * 3 // 4 if r.known >= 0 else most_bytes // 4
        if held[r.known >= 0] + (r.size or 0) <= share:
            held[r.known >= 0] += r.size or 0
            fits.append((r.doc_id, r.hash, r.known))
    if not fits:
        return [], np.zeros(0, int)
    fits = docs.sparkSession.createDataFrame(fits, f"doc_id {dict(docs.dtypes)['doc_id']}, hash long, known int")
    got = thin.withColumn("hash", F.xxhash64("text")).join(F.broadcast(fits), ["doc_id", "hash"]).dropDuplicates(["doc_id"])
    frame = got.select("known", "text").toPandas().sort_values(["known", "text"], na_position="first")
    return [t if isinstance(t, str) else "" for t in frame.text], frame.known.to_numpy(dtype=int)


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    text_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # at most 2 * VOTERS features and the lexicon

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for batch in texts:
            yield batch.map(lambda b: own.score(bytes(b).decode("utf-8", "replace"))).astype(float)

    return docs.withColumn("__score", F.pandas_udf(run, "double")(text_bytes()))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    scored = score(spark, docs.select("doc_id", "text"), train(*learning_rows(docs, labels, rows)))
    mod, left = HELD_OUT
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == left, F.lit(False)).alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below the threshold."""
    model = train(*learning_rows(docs, labels))
    return score(spark, docs, model).where(F.col("__score") < THRESHOLD).select(*docs.columns)
