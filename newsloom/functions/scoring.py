"""Boundary matching and scores as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.functions.arrays import match_nearest

def match(gold: Column, pred: Column, tolerance: Column | int = 25) -> Column:
    """struct(pairs, n_missed, n_spurious): nearest pairs first, each boundary in one pair at most; pairs as consumed."""
    tolerance = F.lit(tolerance) if isinstance(tolerance, int) else tolerance

    def answer(used: Column) -> Column:
        pairs = F.transform(used, lambda x: F.struct(F.get(gold, x["g"]).alias("gold"), F.get(pred, x["p"]).alias("pred")))
        return F.struct(pairs.alias("pairs"), (F.size(gold) - F.size(used)).alias("n_missed"), (F.size(pred) - F.size(used)).alias("n_spurious"))

    return T.let(match_nearest(gold, pred, tolerance), answer)


def mean_offset(pairs: Column) -> Column:
    total = F.aggregate(pairs, F.lit(0).cast("double"), lambda s, x: s + F.abs(x["gold"] - x["pred"]))
    return F.when(F.size(pairs) > 0, total / F.size(pairs)).otherwise(F.lit(0.0))


def prf(tp: Column, fn: Column, fp: Column) -> dict[str, Column]:
    """Precision, recall and F1; 0 where there is nothing to divide by."""
    safe = lambda a, b: F.when(b != 0, a / b).otherwise(F.lit(0.0))
    p, r = safe(tp, tp + fp), safe(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": safe(2 * p * r, p + r)}


def baseline_none() -> Column:
    return F.array().cast("array<bigint>")


def baseline_uniform(gold: Column, n_words: Column) -> Column:
    """As many boundaries as gold has, evenly spaced, rounded half to even."""
    k = F.size(gold)
    step = n_words.cast("double") / (k + 1)
    return F.when(k > 0, F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: F.bround(step * i).cast("bigint"))).otherwise(baseline_none())


def in_guard_zone(local: Column, n: Column, first: Column, last: Column, fraction: float = 0.10) -> Column:
    margin = (F.lit(float(fraction)) * n).cast("int")
    return (~first & (local < margin)) | (~last & (local > n - margin))


def is_degenerate(local: Column, n: Column, first: Column, last: Column) -> Column:
    return (first & (local == 0)) | (last & (local == n))


def spans(breaks: Column, n: Column) -> Column:
    """array<struct<a, b>> of non-empty word ranges between boundaries."""
    n = n.cast("bigint")
    zero = F.array(F.lit(0).cast("bigint"))
    edges = F.arrays_zip(F.concat(zero, breaks).alias("a"), F.concat(breaks, F.array(n)).alias("b"))
    return F.filter(edges, lambda x: x["b"] > x["a"])


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> tuple[Column, Column]:
    """Words shared by two ranges, and their Jaccard overlap (1 for identical empty ranges)."""
    inter = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))
    union = (a1 - a0) + (b1 - b0) - inter
    same = F.when((a0 == b0) & (a1 == b1), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(union != 0, inter).otherwise(F.lit(0)), F.when(union != 0, inter / union).otherwise(same)


def window_starts(n_tokens: Column, window: int, stride: int, min_advance: int = 256) -> Column:
    """The stride grid in tokens, with an end-anchored window if it advances enough."""
    room = F.greatest(n_tokens - window, F.lit(0)).cast("int")
    grid = F.sequence(F.lit(0), room, F.lit(stride))
    return F.when((n_tokens > window) & (room - F.element_at(grid, -1) >= min_advance), F.array_append(grid, room)).otherwise(grid)
