"""Scores of predicted boundaries: matching, rates, Pk and WindowDiff, baselines, breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import scoring as S
from newsloom.functions.text import pin

TOLERANCES = (25, 50, 100)


def align(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """gold (record_id, breaks, ...) with pred_breaks; a record without a prediction predicts nothing.

    Gold defines the denominator: every gold row is scored, repeated ones twice.
    Of repeated predictions the last (by column ordinal, if there is one) counts;
    its word_count, if there is one, comes along as pred_words.
    """
    words = [F.col("word_count").alias("pred_words")] if "word_count" in pred.columns else []
    if "ordinal" in pred.columns:
        pred = pred.groupBy("record_id").agg(F.max_by(F.struct("pred_breaks", *[c for c in ("word_count",) if words]), "ordinal").alias("_p")).select("record_id", "_p.*")
    pred = pred.select("record_id", "pred_breaks", *words, F.lit(True).alias("present"))
    joined = gold.join(pred, "record_id", "left")
    return joined.withColumn("pred_breaks", F.coalesce("pred_breaks", F.array().cast("array<bigint>"))).withColumn("present", F.coalesce("present", F.lit(False)))


def absent_gold(gold: DataFrame, pred: DataFrame) -> DataFrame:
    return gold.join(pred.select("record_id"), "record_id", "left_anti")


def orphans(gold: DataFrame, pred: DataFrame) -> DataFrame:
    return pred.join(gold.select("record_id"), "record_id", "left_anti")


def drift(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Records whose two sides counted different words, so that offsets mean different text."""
    g, p = gold.select("record_id", F.col("word_count").alias("gold_words")), pred.select("record_id", F.col("word_count").alias("pred_words"))
    return g.join(p, "record_id").where("gold_words <> pred_words")


def match_documents(aligned: DataFrame, tolerance: Column | int = 25, gold: str = "breaks", pred: str = "pred_breaks") -> DataFrame:
    """aligned with match (pairs, n_missed, n_spurious), tp, fn, fp of each document; narrow."""
    out = pin(aligned, match=S.match(F.col(gold), F.col(pred), tolerance))
    return out.withColumns({"tp": F.size("match.pairs").cast("bigint"), "fn": F.col("match.n_missed").cast("bigint"), "fp": F.col("match.n_spurious").cast("bigint")})


def pool(matched: DataFrame, *by: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Counts pooled over documents, and the rates; other counts may be summed too."""
    total = matched.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("tp", "fn", "fp", *also)])
    return total.withColumns(S.prf(F.col("tp"), F.col("fn"), F.col("fp")))


def score_tolerances(aligned: DataFrame, tolerances: tuple[int, ...] = TOLERANCES) -> DataFrame:
    """One row of counts and rates for each tolerance, with the F1 gained over the first."""
    spread = aligned.withColumn("tolerance", F.explode(F.array(*[F.lit(t) for t in tolerances])))
    scores = pool(match_documents(spread, F.col("tolerance")), "tolerance")
    first = scores.where(F.col("tolerance") == tolerances[0]).select(F.col("f1").alias("_f1"))
    return scores.crossJoin(F.broadcast(first)).withColumn("f1_gain", F.col("f1") - F.col("_f1")).drop("_f1")


def score_by(aligned: DataFrame, column: str, tolerance: int = 25) -> DataFrame:
    """Rates by outlet or the like, with the number of documents."""
    return pool(match_documents(aligned, tolerance).withColumn("n_docs", F.lit(1)), column, also=("n_docs",))


def pk_window(gold: Column, n: Column) -> Column:
    """Half the mean gold segment, at least 1, rounded half to even; repeated boundaries count."""
    return F.greatest(F.lit(1), F.bround(n.cast("double") / (2 * (F.size(gold) + 1))).cast("int"))


def pk_windowdiff(docs: DataFrame, gold: str = "breaks", pred: str = "pred_breaks", n: str = "word_count", research: bool = False) -> DataFrame:
    """docs with pk and wd; null where a document is too short for one probe.

    The number of boundaries in (i, i + k] changes only where i passes b - k or
    b, so the errors are summed over the stretches between these events: the
    work grows with the boundaries, not the words.  `research` is the variant
    with k of 2 at least and n - 1 at most, repeated boundaries counted twice in
    WindowDiff, and null below 4 words.
    """
    g, p = F.col(gold).cast("array<bigint>"), F.col(pred).cast("array<bigint>")
    words = F.col(n).cast("bigint")
    if research:
        k = F.least(F.greatest(F.lit(2), F.bround(words.cast("double") / (F.size(g) + 1) / 2).cast("bigint")), words - 1)
    else:
        k = pk_window(g, words).cast("bigint")
    base = pin(docs, _k=k, _g=g, _p=p)
    enough = F.col(n) >= 4 if research else F.lit(True)
    usable = enough & (F.col(n) > F.col("_k"))
    limit = F.col(n).cast("bigint") - F.col("_k")
    both = F.concat("_g", "_p")
    # an event e means that the count may differ from probe e on
    events = F.filter(F.concat(F.transform(both, lambda b: b - F.col("_k")), both), lambda e: (e > 0) & (e < limit))
    edges = F.concat(F.array(F.lit(0).cast("bigint")), F.array_sort(F.array_distinct(events)))
    base = base.withColumn("_edges", F.when(usable, edges)).withColumn("_next", F.when(usable, F.concat(F.slice("_edges", F.lit(2), F.greatest(F.size("_edges") - 1, F.lit(0))), F.array(limit))))

    def count(cuts: str, i: Column) -> Column:
        inside = F.filter(cuts, lambda b: (b > i) & (b <= i + F.col("_k")))
        return F.size(inside) if research else F.size(F.array_distinct(inside))

    stretches = F.transform(
        F.arrays_zip(F.col("_edges").alias("a"), F.col("_next").alias("b")),
        lambda e: F.struct((e["b"] - e["a"]).alias("w"), count("_g", e["a"]).alias("g"), count("_p", e["a"]).alias("p")),
    )
    total = lambda bad: F.aggregate("_s", F.lit(0).cast("bigint"), lambda s, x: s + F.when(bad(x), x["w"]).otherwise(F.lit(0)))
    pk = total(lambda x: (x["g"] == 0) != (x["p"] == 0)) / limit
    wd = total(lambda x: x["g"] != x["p"]) / limit
    out = pin(base, _s=F.when(usable, stretches)).withColumns({"pk": F.when(usable, pk), "wd": F.when(usable, wd)})
    return out.drop("_k", "_g", "_p", "_edges", "_next", "_s")


def mean_pk_windowdiff(docs: DataFrame) -> DataFrame:
    return docs.agg(F.avg("pk").alias("mean_pk"), F.avg("wd").alias("mean_wd"), F.count("pk").alias("n_scored"))


def baseline_scores(docs: DataFrame, tolerance: int = 25) -> DataFrame:
    """F1, Pk and WindowDiff of the prediction and of both baselines, one row each."""
    systems = F.array(
        F.struct(F.lit("model").alias("system"), F.col("pred_breaks").cast("array<bigint>").alias("guess")),
        F.struct(F.lit("none").alias("system"), S.baseline_none().alias("guess")),
        F.struct(F.lit("uniform").alias("system"), S.baseline_uniform(F.col("breaks"), F.col("word_count")).alias("guess")),
    )
    spread = docs.withColumn("_x", F.explode(systems)).select("*", "_x.system", "_x.guess").drop("_x")
    scored = pk_windowdiff(match_documents(spread, tolerance, pred="guess"), pred="guess", research=True)
    means = scored.groupBy("system").agg(F.avg("pk").alias("pk"), F.avg("wd").alias("windowdiff"))
    return pool(scored, "system").join(means, "system")


def ship_gate(scores: DataFrame) -> DataFrame:
    """One row, ship: whether the model beats uniform on F1 and both baselines on WindowDiff."""
    at = lambda system, c: F.max(F.when(F.col("system") == system, F.col(c)))
    # a missing or zero WindowDiff reads as 1
    wd = lambda system: F.coalesce(F.nullif(at(system, "windowdiff"), F.lit(0.0)), F.lit(1.0))
    return scores.agg(((at("model", "f1") > at("uniform", "f1")) & (wd("model") < wd("uniform")) & (wd("model") < wd("none"))).alias("ship"))
