"""Vectorized Python functions as column expressions."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def deferred(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    """Like ``pandas_udf``, but made when it is first used, so that a module can be imported without a session."""

    def wrap(fn: Callable) -> Callable[..., Column]:
        @functools.wraps(fn)
        def call(*columns: Column) -> Column:
            return F.pandas_udf(fn, returns)(*columns)

        return call

    return wrap
