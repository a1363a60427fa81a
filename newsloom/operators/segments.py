"""Cutting documents into stories and putting them together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import scan
from newsloom.functions import text as T

FLAGS = ("short", "empty")
GONE = "every segment was dropped"
CARRIED = ("outlet", "show", "date")
MINIMAL = ("record_id", "segment_id", "text", "n_cuts")
_FLAT = ("segment_id", "record_id", "index", "word_start", "word_end", "char_start", "char_end", "n_words", "n_cuts")


def bad_breaks(breaks: Column, n: Column) -> Column:
    """Null, or why these boundaries can't cut a document of n words."""
    outside = F.filter(breaks, lambda b: b.isNull() | (b <= 0) | (b >= n))
    return F.when(breaks.isNull(), F.lit("no usable breaks")).when(F.size(outside) > 0, F.concat(F.lit("boundaries outside (0, "), n.cast("string"), F.lit("): "), F.to_json(outside)))


def checked(docs: DataFrame) -> DataFrame:
    """docs with _n (words), counted once, and error: null, or why the record can't be cut."""
    # pinned: a count written into the lambda over breaks would be taken once for each break
    cut = T.pin(docs.withColumn("_words", T.word_count(F.col("body"))), _n=F.col("_words").cast("bigint")).drop("_words")
    why = F.when(F.col("body").isNull(), "transcript has no usable body").when(F.instr("record_id", "#") > 0, "record_id holds '#'").otherwise(bad_breaks(F.col("breaks"), F.col("_n")))
    return cut.withColumn("error", why)


def to_segments(docs: DataFrame, min_words: int | None = None, include_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each story of docs (record_id, body, breaks); narrow, no shuffle.

    Breaks are sorted and made distinct.  A record that can't be cut gives no
    row here; `segment_errors` names it.  Texts keep the white space after each
    word, so a record's texts joined are its body; no text is made where none is
    asked for.
    """
    good = checked(docs).where("error is null")
    base = T.pin(good.select("record_id", *carry, "breaks", "body"), _cuts=F.array_sort(F.array_distinct("breaks")))
    rows = base.withColumn("_s", scan.cut(F.col("body"), F.col("_cuts"), include_text)).select("record_id", *carry, F.size("_cuts").cast("bigint").alias("n_cuts"), F.posexplode("_s").alias("_i", "x"))
    length = F.col("x.b") - F.col("x.a")
    none = F.array().cast("array<string>")
    short = F.when(length < min_words, F.array(F.lit("short"))).otherwise(none) if min_words is not None else none
    index = F.col("_i").cast("bigint")
    return rows.select(
        T.segment_id(F.col("record_id"), index).alias("segment_id"),
        "record_id",
        index.alias("index"),
        F.col("x.a").alias("word_start"),
        F.col("x.b").alias("word_end"),
        F.col("x.begin").alias("char_start"),
        F.col("x.end").alias("char_end"),
        length.alias("n_words"),
        "n_cuts",
        *([F.col("x.text").alias("text")] if include_text else []),
        F.when(length == 0, F.array(F.lit("empty"))).otherwise(short).alias("flags"),
        *carry,
    )


def with_errors(docs: DataFrame) -> DataFrame:
    """docs with a column error: null, or why the record can't be cut."""
    return checked(docs).select(*docs.columns, "error")


def segment_errors(docs: DataFrame) -> DataFrame:
    return with_errors(docs).where("error is not null").select("record_id", "error")


def minimal(segments: DataFrame) -> DataFrame:
    return segments.select(*[c for c in MINIMAL if c in segments.columns])


def require_full(segments: DataFrame) -> DataFrame:
    """Segments with defaults filled in; a ValueError for minimal rows, which have no offsets."""
    missing = [c for c in ("index", "word_start", "word_end", "char_start", "char_end") if c not in segments.columns]
    if missing:
        raise ValueError(f"segments lack {missing}: this looks like --minimal output, which drops the offsets")
    fill = {"n_words": F.col("word_end") - F.col("word_start"), "n_cuts": F.lit(0).cast("bigint"), "text": F.lit(""), "flags": F.array().cast("array<string>")}
    for name, default in fill.items():
        segments = segments.withColumn(name, F.coalesce(F.col(name), default) if name in segments.columns else default)
    return segments


def drop_flagged(segments: DataFrame, flags: tuple[str, ...] = FLAGS) -> tuple[DataFrame, DataFrame]:
    """Kept and dropped rows."""
    hit = flagged(flags)
    return segments.where(~hit), segments.where(hit)


def flagged(flags: tuple[str, ...] = FLAGS) -> Column:
    return F.arrays_overlap("flags", F.array(*[F.lit(f) for f in flags])) if flags else F.lit(False)


def drop_counts(segments: DataFrame, flags: tuple[str, ...] = FLAGS) -> DataFrame:
    """One row: n_kept, n_dropped, and n_vanished (records all of whose segments are dropped); the segments are read once."""
    own = segments.select("record_id", flagged(flags).alias("_hit")).groupBy("record_id").agg(F.count_if(~F.col("_hit")).alias("_kept"), F.count_if("_hit").alias("_dropped"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint"))
    return own.agg(total("_kept").alias("n_kept"), total("_dropped").alias("n_dropped"), F.count_if(F.col("_kept") == 0).alias("n_vanished"))


def group_by_record(segments: DataFrame, fields: tuple[str, ...], keep: Column | None = None) -> DataFrame:
    """record_id and its segments as an array in index order; of a record none of whose segments are kept an empty one."""
    own = F.struct("index", *[f for f in fields if f != "index"])
    return segments.groupBy("record_id").agg(F.sort_array(F.collect_list(own if keep is None else F.when(keep, own))).alias("segments"))


def merge_segments(segments: DataFrame, check_tail: bool = False, keep: Column | None = None) -> DataFrame:
    """record_id, body, word_count, error: the document, or the first reason that it can't be rebuilt.

    Reasons, in this order: missing or repeated indices; a text left out; then
    segment by segment a text that doesn't fit its span, or a gap.  Offsets alone
    are checked before any text is joined.  check_tail also refuses records
    whose last segments are missing, by n_cuts.  With keep the other segments are
    dropped, and a record that has no more of them is GONE.
    """
    grouped = group_by_record(require_full(segments), ("index", "char_start", "char_end", "text", "n_cuts"), keep)
    seg = F.col("segments")
    in_order = F.forall(F.transform(seg, lambda s, i: s["index"] == i), lambda x: x)
    no_text = F.exists(seg, lambda s: (s["text"] == "") & (s["char_end"] > s["char_start"]))
    fault = F.transform(
        seg,
        lambda s, i: F.when((s["text"] != "") & (F.length(s["text"]) != s["char_end"] - s["char_start"]), F.concat(F.lit("segment "), s["index"].cast("string"), F.lit(": its text was modified"))).when(
            s["char_start"] != F.when(i == 0, F.lit(0)).otherwise(F.get(seg, i - 1)["char_end"]), F.concat(F.lit("segment "), s["index"].cast("string"), F.lit(": not a gapless cover"))
        ),
    )
    first_fault = F.get(F.filter(fault, lambda x: x.isNotNull()), F.lit(0))
    error = F.when(~in_order, "segments are missing or duplicated").when(no_text, "segments carry no text").when(first_fault.isNotNull(), first_fault)
    if check_tail:
        error = F.when(in_order & (F.get(seg, F.lit(0))["n_cuts"] + 1 != F.size(seg)), "last segments are missing").otherwise(error)
    if keep is not None:
        error = F.when(F.size(seg) == 0, GONE).otherwise(error)
    checked = grouped.withColumn("error", error)
    body = F.when(F.col("error").isNull(), F.array_join(F.transform(seg, lambda s: s["text"]), ""))
    return checked.select("record_id", body.alias("body"), "error").select("record_id", "body", T.word_count(F.col("body")).cast("bigint").alias("word_count"), "error")


def merge_strict(segments: DataFrame) -> DataFrame:
    """As merge_segments, but an error ends the job."""
    out = merge_segments(segments)
    return out.withColumn("body", F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "record_id", "error"))).otherwise(F.col("body"))).drop("error")


def vanished(segments: DataFrame, kept: DataFrame) -> DataFrame:
    """Records all of whose segments were dropped."""
    return segments.select("record_id").distinct().join(kept.select("record_id"), "record_id", "left_anti")
