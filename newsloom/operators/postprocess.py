"""From scored windows to boundaries: thresholds, deduplication, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import scoring as S
from newsloom.functions.arrays import chain_means

TAU, RADIUS = 0.01, 25
THRESHOLDS = (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05, 0.02, 0.01, 0.005, 0.0)


def guard(hits: DataFrame, fraction: float = 0.10) -> DataFrame:
    """Rows (local, n_words, is_first, is_last) with guarded and degenerate."""
    args = [F.col(c) for c in ("local", "n_words", "is_first", "is_last")]
    return hits.withColumns({"guarded": S.in_guard_zone(*args, fraction), "degenerate": S.is_degenerate(*args)})


def dedupe(offsets: DataFrame, keys: tuple[str, ...], offset: str = "offset", radius: int = RADIUS) -> DataFrame:
    """One row for each chain of offsets no more than `radius` apart, at its mean rounded half to even."""
    order = Window.partitionBy(*keys).orderBy(offset)
    # the sum's frame takes in equal offsets, so that copies of one stay in one chain
    fresh = F.when(F.col(offset) - F.lag(offset).over(order) <= radius, 0).otherwise(1)
    chained = offsets.withColumn("_new", fresh).withColumn("_chain", F.sum("_new").over(order))
    return chained.groupBy(*keys, "_chain").agg(F.bround(F.avg(offset)).cast("bigint").alias(offset)).drop("_chain")


def dedupe_lists(offsets: Column, radius: int = RADIUS) -> Column:
    """array<bigint>: `dedupe` of the offsets in each list, ascending."""
    return chain_means(offsets, radius)


def _collect(windows: DataFrame, docs: DataFrame, keys: tuple[str, ...], radius: int) -> DataFrame:
    offsets = windows.select(*keys, F.explode("breaks").alias("offset"))
    found = dedupe(offsets, keys, "offset", radius).groupBy(*keys).agg(F.array_sort(F.collect_list("offset")).alias("pred_breaks"))
    # documents in which nothing fired keep an empty list
    return docs.join(found, list(keys), "left").withColumn("pred_breaks", F.coalesce("pred_breaks", F.array().cast("array<bigint>")))


def apply_threshold(windows: DataFrame, docs: DataFrame, tau: float = TAU, radius: int = RADIUS) -> DataFrame:
    """docs (record_id, ...) with pred_breaks, from the windows whose p_break exceeds tau."""
    return _collect(windows.where(F.col("p_break") > tau), docs, ("record_id",), radius)


def sweep(windows: DataFrame, gold: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, tolerance: int = 25, radius: int = RADIUS) -> DataFrame:
    """Windows firing, predictions, counts and rates for each tau, from one scored set of windows.

    Only records on both sides take part.  The thresholds are parameters of a
    fixed number, so the windows are multiplied in place and shuffled once.
    """
    from newsloom.operators import metrics

    taus = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(float(t)).alias("tau")) for i, t in enumerate(thresholds)])
    windows = windows.join(gold.select("record_id").distinct(), "record_id", "left_semi")
    scored = gold.join(windows.select("record_id").distinct(), "record_id", "left_semi")
    fired = windows.withColumn("_t", F.explode(taus)).select("*", "_t.*").where("p_break > tau")
    docs = scored.withColumn("_t", F.explode(taus)).select("*", "_t.*").drop("_t")
    found = _collect(fired, docs, ("record_id", "tau"), radius)
    # counts and predictions in one aggregation; the firing windows in one that reads nothing but p_break
    totals = metrics.pool(metrics.match_documents(found, tolerance).withColumn("n_pred", F.size("pred_breaks")), "tau", "rank", also=("n_pred",))
    counts = windows.select("p_break").agg(*[F.count_if(F.col("p_break") > t).alias(f"_{i}") for i, t in enumerate(thresholds)])
    firing = counts.select(F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.col(f"_{i}").alias("n_firing")) for i in range(len(thresholds))])).alias("x")).select("x.*")
    return totals.join(F.broadcast(firing), "rank")


def best(swept: DataFrame) -> DataFrame:
    """The row of the best F1; the first threshold wins ties."""
    return swept.orderBy(F.desc("f1"), "rank").limit(1)


def greedy_would_fire(windows: DataFrame) -> DataFrame:
    return windows.agg(F.count_if(F.col("p_break") > F.col("p_none")).alias("n_greedy"), F.count(F.lit(1)).alias("n_windows"))


def dump_at(windows: DataFrame, docs: DataFrame, tau: float, radius: int = RADIUS) -> DataFrame:
    """A predictions table at one threshold."""
    return apply_threshold(windows, docs, tau, radius).withColumns({"n_unlocatable_anchors": F.lit(0), "threshold": F.lit(float(tau))})
