"""Folds over arrays that stay linear in their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PART = 32


def emitting(items: Column | str, state: Column, step: Callable, kind: str, last: Callable | None = None) -> Column:
    """array<kind> of the values that a fold emits, in order.

    ``step(state, item)`` gives (next state, whether it emits, the value); ``last(state)`` an array of what is
    left at the end.  Arrays grow by copying, so values are gathered in parts of ``PART``.
    """
    start = F.struct(state.alias("s"), F.array().cast(f"array<{kind}>").alias("part"), F.array().cast(f"array<array<{kind}>>").alias("parts"))

    def merge(a, x):
        s, emits, value = step(a["s"], x)
        full, one = F.size(a["part"]) >= PART, F.array(value.cast(kind))
        return F.struct(
            s.alias("s"),
            F.when(emits, F.when(full, one).otherwise(F.concat(a["part"], one))).otherwise(a["part"]).alias("part"),
            F.when(emits & full, F.concat(a["parts"], F.array(a["part"]))).otherwise(a["parts"]).alias("parts"),
        )

    def finish(a):
        return F.concat(F.flatten(a["parts"]), a["part"], *([last(a["s"])] if last else []))

    return F.aggregate(items, start, merge, finish)
