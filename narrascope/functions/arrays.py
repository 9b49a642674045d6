"""Array helpers built from higher-order functions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spark arrays hold fewer than 2**31 elements, so 31 doubling steps cover any array.
_SCAN_STEPS = 31


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; ``body`` returns an array."""
    return F.flatten(F.transform(F.array(value), body))


def bind_value(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, which may use it many times and return any type.

    Outside generated code Catalyst computes an expression again at each place that names it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_sum(values: Column) -> Column:
    """Inclusive running sum (as ``array<bigint>``) of an integer array, in linear work per doubling step.

    Hillis-Steele scan: after step k every element holds the sum of the 2**k
    elements ending at it. The steps are one ``aggregate`` over their numbers, so the
    expression stays small whatever their number; a text of n tokens costs O(n log n), not O(n^2).
    """
    return F.aggregate(F.sequence(F.lit(0), F.lit(_SCAN_STEPS - 1)), F.transform(values, lambda v: v.cast("long")), _scan_step)


def _scan_step(xs: Column, k: Column) -> Column:
    n, step = F.size(xs), F.element_at(F.lit([1 << i for i in range(_SCAN_STEPS)]), k + 1)
    # add the array shifted right by ``step`` (zeros in front)
    shifted = F.concat(F.array_repeat(F.lit(0).cast("long"), F.least(step, n)),
                       F.slice(xs, F.lit(1), F.greatest(n - step, F.lit(0))))
    # once ``step`` reaches the length the array is final: skip the work
    return F.when(n > step, F.zip_with(xs, shifted, lambda a, b: a + b)).otherwise(xs)
