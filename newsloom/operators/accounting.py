"""What went in and what came out: the checks that keep a short result from looking like a whole one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators import segments

CARRIED = segments.CARRIED


def cuts(transcripts: DataFrame, predictions: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Predictions joined to their transcripts: record_id, body, breaks, carry, problem (null, or why the record can't be cut) and fatal.

    transcripts: record_id, body and, if read strictly, ordinal (of a repeated
    record the last counts) and error.  predictions: record_id, pred_breaks and,
    if there are, word_count and error.  Fatal is a prediction without a
    transcript or for another text: then nothing is worth writing.
    """
    null = F.lit(None).cast("string")
    place = F.col("ordinal") if "ordinal" in transcripts.columns else F.lit(0)
    fields = [F.col("body"), *[F.col(c) for c in carry], (F.col("error") if "error" in transcripts.columns else null).alias("error")]
    last = transcripts.groupBy("record_id").agg(F.max_by(F.struct(*fields), place).alias("_t"))
    told = F.col("word_count") if "word_count" in predictions.columns else F.lit(None)
    own = predictions.select("record_id", F.col("pred_breaks").alias("breaks"), told.cast("bigint").alias("_told"), (F.col("error") if "error" in predictions.columns else null).alias("_own"))
    joined = own.join(last, "record_id", "left").select("record_id", "breaks", "_told", "_own", F.col("_t").isNull().alias("_missing"), F.col("_t.body").alias("body"), F.col("_t.error").alias("_their"), *[F.col(f"_t.{c}").alias(c) for c in carry])
    cut = segments.checked(joined)
    drift = F.coalesce(F.col("_told") != F.col("_n"), F.lit(False))
    other = F.concat(F.lit("it was predicted for "), F.col("_told").cast("string"), F.lit(" words of different text, the transcript has "), F.col("_n").cast("string"))
    problem = F.when(F.col("_missing"), "no transcript").when(drift, other).otherwise(F.coalesce("_their", "_own", "error"))
    return cut.select("record_id", "body", "breaks", *carry, problem.alias("problem"), (F.col("_missing") | drift).alias("fatal"))


def merged(rows: DataFrame, drop_flagged: bool = False) -> DataFrame:
    """record_id, body, word_count, outcome (rebuilt, failed or vanished), error: one row for each record that went in.

    Flagged segments are left out of the groups, not of the rows, so that a record
    all of whose segments are dropped still has a group; the rows are read once.
    """
    out = segments.merge_segments(rows, keep=~segments.flagged() if drop_flagged else None)
    outcome = F.when(F.col("error").isNull(), "rebuilt").when(F.col("error") == segments.GONE, "vanished").otherwise("failed")
    return out.select("record_id", "body", "word_count", outcome.alias("outcome"), "error")


def scored(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: n_gold, n_pred, n_shared, n_absent (gold without prediction), at_stake (their breaks), n_orphans (the reverse), n_drift."""
    side = lambda df, g, p, breaks: df.select("record_id", F.col("word_count").alias("w"), F.lit(g).alias("g"), F.lit(p).alias("p"), breaks.alias("s"))
    both = side(gold, 1, 0, F.size("breaks")).unionByName(side(pred, 0, 1, F.lit(0)))
    words = both.groupBy("record_id", "w").agg(*[F.sum(c).alias(c) for c in "gps"])
    told = lambda c: F.coalesce(F.sum(F.when(F.col("w").isNotNull(), c)), F.lit(0))
    own = words.groupBy("record_id").agg(*[F.sum(c).alias(c) for c in "gps"], (told(F.col("g")) * told(F.col("p")) - told(F.col("g") * F.col("p"))).alias("d"))
    # a null id is nobody's
    alone = lambda c: F.col("record_id").isNull() | (F.col(c) == 0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint"))
    return own.agg(
        total("g").alias("n_gold"), total("p").alias("n_pred"), F.count_if((F.col("g") > 0) & (F.col("p") > 0)).alias("n_shared"),
        total(F.when(alone("p"), F.col("g"))).alias("n_absent"), total(F.when(alone("p"), F.col("s"))).alias("at_stake"),
        total(F.when(alone("g"), F.col("p"))).alias("n_orphans"), total(F.when(F.col("record_id").isNotNull(), F.col("d"))).alias("n_drift"),
    )


def expected(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """The gold of the records that a split has rows of: what a score of the split is about, whatever was predicted."""
    return gold.join(rows.select("record_id").intersect(gold.select("record_id")), "record_id", "left_semi")
