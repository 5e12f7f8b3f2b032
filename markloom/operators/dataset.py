"""Training conversations and generated output."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import batched
from ..functions.metrics import parse_spec_udf
from ..functions.pycode import repair_udf
from ..functions.scripts import extract_code
from ..plans.script import script_or_stub

#: Names of the two tasks; the wording of an instruction is the caller's.
SPEC_TASK, CODE_TASK = "spec", "code"
MOST_CODE = 3000


def task_of(vega_spec: Column) -> Column:
    """C20: the task that a sample's spec implies."""
    return F.when(parse_spec_udf(vega_spec).isNotNull(), SPEC_TASK).otherwise(CODE_TASK)


@batched("string")
def _script_of_spec(text: pd.Series) -> pd.Series:
    return text.map(script_or_stub)


def reference_code(vega_spec: Column, code: Column) -> Column:
    """The script of the sample's spec, or its code; a sample with neither is an error."""
    spec = parse_spec_udf(vega_spec)
    return F.when(spec.isNotNull(), _script_of_spec(vega_spec)).otherwise(F.coalesce(code, F.raise_error(F.lit("a sample has neither spec nor code")).cast("string")))


def generated_code(text: Column, task: Column) -> Column:
    """The code of a generated answer: for code the repaired last block; for a spec its drawing script, or a stub that fails when run."""
    return F.when(task == CODE_TASK, repair_udf(extract_code(text))).otherwise(_script_of_spec(text))


MESSAGES = "array<struct<role:string,content:array<struct<type:string,text:string,image:string>>>>"


def conversations(samples: DataFrame, instructions: dict[str, str], order_by: str | None = None) -> DataFrame:
    """Samples (image, code, vega_spec) with messages, instruction, target_text; rows without a target or image go.

    `ordinal` is the rows' order: that of a column, or else that of the rows as they are read.
    """
    spec = parse_spec_udf("vega_spec")
    target = F.coalesce(spec, F.col("code"))
    instruction = F.when(spec.isNotNull(), instructions[SPEC_TASK]).otherwise(instructions[CODE_TASK])
    with_target = samples.withColumns({"target_text": target, "instruction": instruction}).where("target_text is not null and image is not null")
    none = F.lit(None).cast("string")
    part = lambda kind, text, image: F.struct(F.lit(kind).alias("type"), text.alias("text"), image.alias("image"))
    user = F.struct(F.lit("user").alias("role"), F.array(part("image", none, F.col("image")), part("text", F.col("instruction"), none)).alias("content"))
    assistant = F.struct(F.lit("assistant").alias("role"), F.array(part("text", F.col("target_text"), none)).alias("content"))
    ordinal = F.col(order_by) if order_by else F.monotonically_increasing_id()
    return with_target.withColumns({"messages": F.array(user, assistant), "image_path": F.col("image"), "ordinal": ordinal})


def first_of(messages: Column, kind: str, role: str = "user") -> Column:
    """D3: the first part of a kind in the messages of a role."""
    parts = F.flatten(F.transform(F.filter(messages, lambda m: m["role"] == role), lambda m: m["content"]))
    return F.get(F.filter(parts, lambda p: p["type"] == kind), F.lit(0))[kind]


def with_drop_reason(df: DataFrame, spec_instruction: str, most_code: int = MOST_CODE, most_tokens: int | None = None, count_tokens: Callable[[list[str]], list[int]] | None = None, spec_exempt: bool = True) -> DataFrame:
    """Df (messages, instruction, vega_spec) with drop_reason, null for rows to keep.

    The target is the text of the second message's first part. `count_tokens` counts some texts at once, each the
    instruction and the target; texts on which it fails are counted one by one, and a row on which that fails is kept.
    """
    is_spec = parse_spec_udf("vega_spec").isNotNull() | (F.col("instruction") == spec_instruction)
    answer = F.try_element_at("messages", F.lit(2))["content"]
    target = F.coalesce(F.try_element_at(answer, F.lit(1))["text"], F.lit(""))
    empty = (F.coalesce(F.size("messages"), F.lit(0)) < 2) | (F.coalesce(F.size(answer), F.lit(0)) < 1)
    long = F.length(target) > most_code
    reason = F.when(empty, "empty").when((long & ~F.coalesce(is_spec, F.lit(False))) if spec_exempt else long, "code length")
    if most_tokens is not None and count_tokens is not None:

        def counted(texts: list[str]) -> list[int]:
            try:
                return list(count_tokens(texts))
            except Exception:  # noqa: BLE001  the tokenizer is the caller's
                return [0] if len(texts) == 1 else [counted([t])[0] for t in texts]

        @F.pandas_udf("long")
        def tokens(texts: pd.Series) -> pd.Series:
            return pd.Series(counted(texts.fillna("").tolist()), dtype="int64")

        reason = reason.when(tokens(F.concat_ws("\n", "instruction", target)) > most_tokens, "tokens")
    return df.withColumn("drop_reason", reason)


def dropped_counts(df: DataFrame) -> DataFrame:
    """Rows by reason."""
    return df.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
