"""Problems in transcripts and annotations, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as T


def _repeated(df: DataFrame, what: str) -> DataFrame:
    return df.groupBy("record_id").count().where("count > 1").select("record_id", F.lit(f"duplicate {what} record_id").alias("problem"))


def cross_file(transcripts: DataFrame, annotations: DataFrame) -> DataFrame:
    """record_id, problem: repeats, wrong word counts, orphans, drift, offsets out of range or not ascending.

    An annotation that drifted is not looked at further.  A transcript without a
    body is a problem, not a crash.
    """
    n = T.word_count(F.col("body"))
    counted = transcripts.select("record_id", F.when(F.col("body").isNull(), "body is missing").when(F.col("word_count").isNull() | (F.col("word_count") != n), F.concat(F.lit("word_count is not the body's "), n.cast("string"))).alias("problem")).where("problem is not null")
    words = transcripts.groupBy("record_id").agg(F.max("word_count").alias("n"))
    # one row per transcript on the right, so repeats can't multiply annotations
    a = annotations.select("record_id", "word_count", "breaks").join(words.withColumn("known", F.lit(True)), "record_id", "left")
    outside = F.filter("breaks", lambda b: (b <= 0) | (b >= F.col("n")))
    why = F.when(F.col("known").isNull(), F.array(F.lit("no matching transcript"))).when(F.col("word_count") != F.col("n"), F.array(F.lit("annotated against different text")))
    why = why.otherwise(F.filter(F.array(F.when(F.size(outside) > 0, F.concat(F.lit("offsets out of range: "), F.to_json(outside))), F.when(F.col("breaks") != F.array_sort("breaks"), "breaks are not ascending")), lambda x: x.isNotNull()))
    found = a.select("record_id", F.explode(why).alias("problem"))
    return _repeated(transcripts, "transcript").unionByName(counted).unionByName(_repeated(annotations, "annotation")).unionByName(found)


def structural(df: DataFrame, kind: str) -> DataFrame:
    """record_id, problem: the rules that one row of a transcript, annotation, prediction or segment table must meet."""
    has = set(df.columns)
    rules: list[tuple[str, Column]] = []

    def rule(needs: str, name: str, broken: Column) -> None:
        if needs in has:
            rules.append((name, broken))

    rules.append(("record_id is required", F.col("record_id").isNull() | (F.col("record_id") == "")))
    required = {"transcript": ("body", "word_count"), "annotation": ("breaks", "word_count", "category"), "prediction": ("pred_breaks", "word_count"), "segment": ("segment_id", "index", "word_start", "word_end", "char_start", "char_end", "n_words", "n_cuts")}[kind]
    for name in required:
        rules.append((f"{name} is required", F.col(name).isNull() if name in has else F.lit(True)))
    rule("word_count", "word_count is negative", F.col("word_count") < 0)
    rule("date", "date is not YYYY-MM-DD", ~F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}\z"))
    rule("month", "month is not two digits", ~F.col("month").rlike(r"^\d{2}\z"))
    rule("type", "type is neither dump nor segment", ~F.col("type").isin("dump", "segment")) if kind == "transcript" else None
    if kind == "annotation":
        rule("breaks", "breaks repeat", F.size(F.array_distinct("breaks")) != F.size("breaks"))
        rule("breaks", "a break is less than 1", F.exists("breaks", lambda b: b < 1))
        rule("category", "category is neither A nor C", ~F.col("category").isin("A", "C"))
        rule("category", "category doesn't fit the breaks", (F.col("category") == "A") != (F.size("breaks") > 0))
    if kind == "prediction":
        rule("tau", "tau is outside [0, 1]", ~F.col("tau").between(0, 1))
        for name in ("n_unlocatable_anchors", "n_ambiguous_anchors"):
            rule(name, f"{name} is negative", F.col(name) < 0)
    if kind == "segment":
        rule("segment_id", "segment_id has the wrong form", ~F.col("segment_id").rlike(r"^.+#\d+\z"))
        rule("flags", "an unknown flag", F.size(F.array_except("flags", F.array(F.lit("short"), F.lit("empty")))) > 0)
    checks = F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]), lambda x: x.isNotNull())
    return df.select("record_id", F.explode(checks).alias("problem"))


def usable_annotations(transcripts: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotations that can be trusted, their breaks sorted and distinct; and record_id, reason of the rest."""
    n = transcripts.select("record_id", T.word_count(F.col("body")).alias("_n")).dropDuplicates(["record_id"])
    joined = annotations.join(n, "record_id", "left")
    outside = F.filter("breaks", lambda b: (b <= 0) | (b >= F.col("_n")))
    reason = F.when(F.col("_n").isNull(), "no matching transcript").when(F.col("_n") != F.col("word_count"), "word_count differs").when(F.size(outside) > 0, "break offsets out of range")
    judged = joined.withColumn("reason", reason)
    good = judged.where("reason is null").withColumn("breaks", F.array_sort(F.array_distinct("breaks"))).drop("_n", "reason")
    return good, judged.where("reason is not null").select("record_id", "reason")
