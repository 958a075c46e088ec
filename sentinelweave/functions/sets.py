"""Small array helpers built on higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also inside lambdas, where Spark shares no expressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def distinct_by(array: Column, key: Callable[[Column], Column]) -> Column:
    """Keep the first element for each key, in order; null keys compare equal."""
    keys = F.transform(array, key)
    return F.filter(array, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def set_f1(gold: Column, pred: Column) -> Column:
    """F1 of two key arrays without repeats: both empty 1, one empty 0.

    With s shared keys, 2pr/(p+r) is 2s/(|g|+|p|), so the intersection is taken once.
    """
    total = F.size(gold) + F.size(pred)
    return F.when(total == 0, F.lit(1.0)).otherwise(2 * F.size(F.array_intersect(gold, pred)) / total)


def prf(tp: Column, fp: Column, fn: Column) -> Column:
    """Precision, recall and F1 rounded to six places; empty denominators give 1.0."""
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(1.0))
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(1.0))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return F.struct(
        F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1")
    )
