"""Row-wise similarity of a generated script or spec to its reference."""

from __future__ import annotations

import difflib
import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.spec import canonical_text, flatten, is_supported, kind_of, parse_spec
from .batches import batched

WEIGHTS = {"bleu": 0.4, "edit_sim": 0.3, "api_sim": 0.3}
IR = "ir_exact_match boolean, ir_field_precision double, ir_field_recall double, ir_field_f1 double, ir_tree_similarity double"


def bleu(reference: str | None, candidate: str | None, order: int = 4, epsilon: float = 0.1) -> float:
    """M1: sentence BLEU over words; an n-gram order without a match counts `epsilon` matches."""
    ref, got = (reference or "").split(), (candidate or "").split()
    logs = 0.0
    for n in range(1, order + 1):
        own = Counter(zip(*(got[i:] for i in range(n)), strict=False))
        other = Counter(zip(*(ref[i:] for i in range(n)), strict=False))
        hits = sum((own & other).values())
        if n == 1 and not hits:
            return 0.0
        logs += math.log((hits or epsilon) / max(1, sum(own.values()))) / order
    short = 1.0 if len(got) > len(ref) else math.exp(1 - len(ref) / len(got))
    return short * math.exp(logs)


def edit_similarity(reference: str | None, candidate: str | None) -> float:
    """M2: matching blocks with the popular-character heuristic, in this order of arguments."""
    return difflib.SequenceMatcher(None, reference or "", candidate or "").ratio()


def _ratio(part: int, whole: int) -> float:
    return part / whole if whole else 0.0


def ir_scores(reference: str | None, candidate: str | None) -> dict:
    """M6: how far two specs agree, over their flattened leaves; all zero if either is missing."""
    a, b = parse_spec(reference), parse_spec(candidate)
    if a is None or b is None:
        return dict.fromkeys([c.split()[0] for c in IR.split(", ")], 0.0) | {"ir_exact_match": False}
    fa, fb = flatten(a), flatten(b)
    one, two = set(fa.items()), set(fb.items())
    both = len(one & two)
    precision, recall = _ratio(both, len(two)), _ratio(both, len(one))
    jaccard = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    return {
        "ir_exact_match": a == b,
        "ir_field_precision": precision,
        "ir_field_recall": recall,
        "ir_field_f1": 2 * precision * recall / (precision + recall) if precision + recall else 0.0,
        "ir_tree_similarity": 0.5 * jaccard(set(fa), set(fb)) + 0.5 * jaccard(one, two),
    }


@batched("double")
def bleu_udf(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    return pd.Series([bleu(a, b) for a, b in zip(reference, candidate, strict=True)])


@batched("double")
def edit_similarity_udf(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    return pd.Series([edit_similarity(a, b) for a, b in zip(reference, candidate, strict=True)])


@batched(IR)
def ir_scores_udf(reference: pd.Series, candidate: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([ir_scores(a, b) for a, b in zip(reference, candidate, strict=True)])


@batched("string")
def parse_spec_udf(text: pd.Series) -> pd.Series:
    """V1 and V3 for a column: canonical text of the first spec in it, or null."""
    return text.map(lambda t: canonical_text(s, compact=True) if (s := parse_spec(t)) is not None else None)


@batched("kind string, supported boolean")
def classify_udf(text: pd.Series) -> pd.DataFrame:
    """V5 and V6 for a column."""
    specs = [parse_spec(t) for t in text]
    return pd.DataFrame({"kind": [kind_of(s) if s else None for s in specs], "supported": [bool(s) and is_supported(s) for s in specs]})


@batched("map<string,string>")
def flatten_udf(text: pd.Series) -> pd.Series:
    """V8 for a column."""
    return text.map(lambda t: flatten(s) if (s := parse_spec(t)) is not None else {})


def call_overlap(reference: Column, candidate: Column) -> Column:
    """M3: api_sim (recall of distinct calls; 0 without reference calls), jaccard, matched, missed, extra."""
    ref, got = F.array_distinct(reference), F.array_distinct(candidate)
    both = F.array_intersect(ref, got)
    part = lambda whole: F.when(whole > 0, F.size(both) / whole).otherwise(0.0)
    return F.struct(part(F.size(ref)).alias("api_sim"), part(F.size(F.array_union(ref, got))).alias("jaccard"), both.alias("matched"), F.array_except(ref, got).alias("missed"), F.array_except(got, ref).alias("extra"))


def code_score(b: Column, e: Column, a: Column) -> Column:
    """M4."""
    return b * WEIGHTS["bleu"] + e * WEIGHTS["edit_sim"] + a * WEIGHTS["api_sim"]


def overall(ssim: Column, code: Column) -> Column:
    """M5."""
    return ssim * 0.5 + code * 0.5


def on_success(success: Column, score: Column) -> Column:
    """M7: a score counts only if the code ran; scores of the spec itself don't pass through here."""
    return F.when(success, score).otherwise(0.0)
