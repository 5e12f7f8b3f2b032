"""Arrow-batched functions that can be defined without a session, and imported by Python workers."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def batched(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    """A function of columns out of one of pandas series; the UDF is made where it is called."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns) -> Column:
            return F.pandas_udf(f, returns)(*columns)

        return call

    return wrap
