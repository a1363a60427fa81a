"""Training data: clipped windows, targets, splits, reports, mined errors."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions import anchors as A
from newsloom.functions import scan
from newsloom.functions import scoring as S
from newsloom.functions import text as T
from newsloom.functions.arrays import bisect_left
from newsloom.operators import metrics


@dataclass(frozen=True)
class Clipping:
    """Window geometry of a training set, in tokens."""

    window: int = 4096
    stride: int = 3072
    guard_lo: int = 400
    guard_hi: int = 3696
    min_window: int = 1024
    min_advance: int = 256
    jitter: int = 0

    @property
    def tail(self) -> int:
        return self.window - self.guard_hi


#: Windows, stride ratios and guards of the variant grid.
GRID = ((2048, 3072, 4096), (0.50, 0.75), (200, 300, 400))


def variant_id(window: Column, stride: Column, guard: Column) -> Column:
    return F.format_string("w%d_s%d_g%d", window, stride, guard)


def clip(t0: Column, t1: Column, breaks: Column, c: Clipping | dict) -> Column:
    """struct(t0, t1, category, note): a window whose edges are moved past the breaks in its guard bands.

    Up to 32 turns in a fold.  Empty strings stand for "none", as null fields in
    the state of a fold fail.  category '' means rejected, note says why.
    """
    p = c if isinstance(c, dict) else {"guard_lo": F.lit(c.guard_lo), "tail": F.lit(c.tail), "min_window": F.lit(c.min_window), "jitter": F.lit(c.jitter)}
    state = lambda a, b, category, note, clipped, done: F.struct(a.cast("int").alias("t0"), b.cast("int").alias("t1"), category.alias("category"), note.alias("note"), clipped.alias("clipped"), done.alias("done"))
    no, yes, empty = F.lit(False), F.lit(True), F.lit("")

    def turn(s: Column, _: Column) -> Column:
        lead = F.array_max(F.filter(breaks, lambda b: (b > s["t0"]) & (b < s["t0"] + p["guard_lo"])))
        trail = F.array_min(F.filter(breaks, lambda b: (b > s["t1"] - p["tail"]) & (b < s["t1"])))
        inside = F.exists(breaks, lambda b: (b > s["t0"]) & (b < s["t1"]))
        width = s["t1"] - s["t0"]
        clean = F.when(inside, F.lit("true_transition")).otherwise(F.lit("pure_continuation"))
        return (
            F.when(s["done"], s)
            .when(width < p["guard_lo"] + p["tail"], state(s["t0"], s["t1"], empty, F.lit("window_shorter_than_guard_bands"), s["clipped"], yes))
            .when(width < p["min_window"], state(s["t0"], s["t1"], empty, F.lit("clipped_below_min_window"), s["clipped"], yes))
            .when(lead.isNull() & trail.isNull(), state(s["t0"], s["t1"], clean, F.when(s["clipped"], F.lit("clipped")).otherwise(empty), s["clipped"], yes))
            .otherwise(state(F.coalesce(lead + p["jitter"], s["t0"]), F.coalesce(trail - p["jitter"], s["t1"]), empty, empty, yes, no))
        )

    end = lambda s: F.struct(s["t0"].alias("t0"), s["t1"].alias("t1"), s["category"].alias("category"), F.when(s["done"], s["note"]).otherwise(F.lit("clip_did_not_converge")).alias("note"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), state(t0, t1, empty, empty, no, no), turn, end)


def _windows(annotated: DataFrame, starts: Column, window: Column, p: Clipping | dict, keys: tuple[str, ...], prompt: A.PromptSpec) -> DataFrame:
    """annotated (record_id, words, w2t, n_tokens, breaks, ...) -> all windows, with reject_reason where rejected."""
    tokens = F.transform("breaks", lambda b: F.get("w2t", b.cast("int")))
    rows = T.pin(annotated, _tok=tokens, _s=starts)
    # all windows of a document are clipped and cut before rows are made of them, so that a row carries its own words only
    def clipped(s: Column) -> Column:
        end = F.least(s + window, F.col("n_tokens"))
        return F.struct(s.alias("g0"), end.alias("g1"), clip(s, end, F.col("_tok"), p).alias("c"))

    rows = T.pin(rows, _c=F.transform("_s", clipped))
    rows = rows.withColumns({"_low": bisect_left(F.col("w2t"), F.col("_c.c.t0")), "_high": bisect_left(F.col("w2t"), F.col("_c.c.t1"))})
    inside = lambda e: F.filter("breaks", lambda b: (b > e["_low"]) & (b < e["_high"]))
    own = lambda e: F.struct(
        e["_c"].alias("c"), e["_low"].alias("low"), e["_high"].alias("high"), inside(e).alias("breaks"),
        F.transform(inside(e), lambda b: F.get("w2t", b.cast("int")) - e["_c"]["c"]["t0"]).alias("tokens"),
        F.slice("words", e["_low"] + 1, F.greatest(e["_high"] - e["_low"], F.lit(0))).alias("w"),
    )
    kept = [c for c in annotated.columns if c not in ("words", "w2t", "body")]
    rows = rows.select(*kept, F.explode(F.transform(F.arrays_zip("_c", "_low", "_high"), own)).alias("_x"))
    rows = rows.withColumns(
        {
            "grid_tok_start": F.col("_x.c.g0"),
            "grid_tok_end": F.col("_x.c.g1"),
            "win_tok_start": F.col("_x.c.c.t0"),
            "win_tok_end": F.col("_x.c.c.t1"),
            "win_word_start": F.col("_x.low"),
            "win_word_end": F.col("_x.high"),
            "breaks_global": F.col("_x.breaks"),
            "was_clipped": F.col("_x.c.c.note") == "clipped",
            "breaks_local_tok": F.col("_x.tokens"),
            "breaks_local_word": F.transform("_x.breaks", lambda b: b - F.col("_x.low")),
            "n_breaks": F.size("_x.breaks"),
            "category": F.nullif(F.col("_x.c.c.category"), F.lit("")),
            "_w": F.col("_x.w"),
            "_note": F.col("_x.c.c.note"),
        }
    ).drop("_x")
    rejected = F.col("category").isNull() | (F.col("win_word_end") <= F.col("win_word_start"))
    reason = F.when(rejected, F.coalesce(F.nullif(F.col("_note"), F.lit("")), F.lit("empty_word_span")))
    lost = F.filter("breaks_local_word", lambda b: ~A.locate(F.col("_w"), F.array_join(F.slice("_w", (F.greatest(b - prompt.anchor_pre_words, F.lit(0)) + 1).cast("int"), F.least(b, F.lit(prompt.anchor_pre_words)).cast("int")), " "))["offset"].eqNullSafe(b.cast("int")))
    return rows.withColumns({"input_text": F.array_join("_w", " "), "target_text": A.build_target(F.col("_w"), F.col("breaks_local_word"), prompt), "n_anchors_unlocatable": F.size(lost), "reject_reason": reason}).drop("_w", "_note")


def build_rows(annotated: DataFrame, c: Clipping = Clipping(), prompt: A.PromptSpec = A.PromptSpec()) -> tuple[DataFrame, DataFrame]:
    """Training rows and rejected windows of annotated token maps."""
    rows = _windows(annotated, S.window_starts(F.col("n_tokens"), c.window, c.stride, c.min_advance), F.lit(c.window), c, (), prompt)
    return rows.where("reject_reason is null").drop("reject_reason"), rows.where("reject_reason is not null").drop("input_text", "target_text", "n_anchors_unlocatable")


def build_variants(annotated: DataFrame, grid: tuple = GRID, min_advance: int = 256, prompt: A.PromptSpec = A.PromptSpec()) -> DataFrame:
    """All windows of all geometries from token maps that were computed once; variant_id, reject_reason."""
    windows, ratios, guards = grid
    cells = [F.struct(F.lit(w).alias("w"), F.lit(int(w * r)).alias("s"), F.lit(r).alias("r"), F.lit(g).alias("g")) for w in windows for r in ratios for g in guards]
    rows = annotated.withColumn("_v", F.explode(F.array(*cells))).select("*", F.col("_v.w").alias("window_tokens"), F.col("_v.s").alias("stride_tokens"), F.col("_v.r").alias("stride_ratio"), F.col("_v.g").alias("edge_guard_lo")).drop("_v")
    rows = rows.withColumn("variant_id", variant_id(F.col("window_tokens"), F.col("stride_tokens"), F.col("edge_guard_lo")))
    w, s, n = F.col("window_tokens"), F.col("stride_tokens"), F.col("n_tokens")
    room = F.greatest(n - w, F.lit(0)).cast("int")
    strides = F.sequence(F.lit(0), room, s)
    starts = F.when((n > w) & (room - F.element_at(strides, -1) >= min_advance), F.array_append(strides, room)).otherwise(strides)
    p = {"guard_lo": F.col("edge_guard_lo"), "tail": F.col("edge_guard_lo"), "min_window": F.floor(w / 4).cast("int"), "jitter": F.lit(0)}
    return _windows(rows, starts, w, p, (), prompt)


def manifest(variants: DataFrame, n_gold: int, splits: DataFrame | None = None) -> DataFrame:
    """One row for each variant: rows, rejects, shares, breaks covered."""
    kept = F.col("reject_reason").isNull()
    rows = variants.join(splits, "record_id", "left") if splits is not None else variants.withColumn("split", F.lit(None).cast("string"))
    out = rows.groupBy("variant_id", "window_tokens", "stride_tokens", "stride_ratio", "edge_guard_lo").agg(
        F.count_if(kept).alias("n_rows"),
        F.count_if(~kept).alias("n_rejected"),
        *[F.count_if(kept & (F.col("split") == s)).alias(f"n_{s}") for s in ("train", "val", "test")],
        F.count_if(kept & (F.col("category") == "true_transition")).alias("n_cat_a"),
    )
    covered = variants.where(kept).select("variant_id", "record_id", F.explode("breaks_global").alias("b")).groupBy("variant_id").agg(F.count_distinct("record_id", "b").alias("breaks_covered"))
    out = out.join(covered, "variant_id", "left").fillna(0, ["breaks_covered"])
    return out.withColumns({"max_seq_len": F.col("window_tokens") + 1024, "cat_a_share": F.col("n_cat_a") / F.greatest(F.lit(1), F.col("n_rows")), "coverage": F.col("breaks_covered") / F.lit(n_gold)})


def _ranked(ids: DataFrame, seed: int, *by: str) -> DataFrame:
    """ids (record_id, ...) with _r, the place in the order of a hash within each group, and _n, the size of the group.

    Places are counted within hash buckets and what the buckets before hold is added, so that no group is one task.
    """
    hashed = ids.withColumn("_h", F.xxhash64(F.lit(seed), "record_id")).withColumn("_b", F.shiftright("_h", 52))
    sizes = hashed.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_k"))
    # at most 4,096 buckets a group
    own = W.partitionBy(*by) if by else W.partitionBy()
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_k").over(own.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "_n": F.sum("_k").over(own)})
    order = W.partitionBy(*by, "_b").orderBy("_h", "record_id")
    return hashed.join(F.broadcast(sizes.drop("_k")), [*by, "_b"]).withColumn("_r", F.row_number().over(order) + F.col("_before")).drop("_h", "_b", "_before")


def assign_splits(annotations: DataFrame, fraction: float = 0.12, seed: int = 42) -> DataFrame:
    """record_id, split: held-out records test; of each category, a share in hash order val; the rest train.

    Sizes are max(1, round-half-even(share)); membership follows a hash, so that
    no ids are gathered.  `shuffled_splits` gives the seeded shuffle's members.
    """
    pool = _ranked(annotations.where("not heldout").select("record_id", "category"), seed, "category")
    take = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(float(fraction))).cast("int"))
    chosen = pool.select("record_id", F.when(F.col("_r") <= take, "val").otherwise("train").alias("split"))
    return annotations.where("heldout").select("record_id", F.lit("test").alias("split")).unionByName(chosen)


def shuffled_splits(annotations: DataFrame, fraction: float = 0.12, seed: int = 42) -> DataFrame:
    """As assign_splits, with the members that Python's seeded shuffle picks; gathers record ids (no texts) on the driver."""
    spark, rng, rows = annotations.sparkSession, random.Random(seed), []
    by_category: dict[str, list[str]] = {}
    for r in annotations.select("record_id", "category", "heldout").collect():
        if r.heldout:
            rows.append((r.record_id, "test"))
        else:
            by_category.setdefault(r.category, []).append(r.record_id)
    for _, ids in sorted(by_category.items()):
        ids.sort()
        rng.shuffle(ids)
        cut = max(1, round(len(ids) * fraction))
        rows += [(i, "val" if k < cut else "train") for k, i in enumerate(ids)]
    return spark.createDataFrame(rows, "record_id string, split string")


def sample_by_record(rows: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """The rows of a share of the records, the first in the order of a hash, never a share of one record's rows."""
    ranked = _ranked(rows.select("record_id").distinct(), seed)
    keep = ranked.where(F.col("_r") <= F.greatest(F.lit(1), (F.col("_n") * F.lit(float(fraction))).cast("int"))).select("record_id")
    return rows.join(keep, "record_id", "left_semi")


def quantiles(rows: DataFrame, value: Column, **wanted: Column) -> DataFrame:
    """One row: for each name the value at a place, from 0, of the sorted values, never interpolated; null if there are none.

    wanted gives the places in terms of a column n, the number of values.  Values are counted first, so that what one
    task sorts is the different ones; of widths there are no more than a window has tokens.
    """
    counts = rows.select(value.alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("k"))
    order = W.orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.withColumns({"last": F.sum("k").over(order), "n": F.sum("k").over(W.partitionBy())})
    return ranked.agg(*[F.max(F.when((place >= F.col("last") - F.col("k")) & (place < F.col("last")), F.col("v"))).alias(name) for name, place in wanted.items()])


def lower(q: float) -> Column:
    """The place of a lower quantile: int(q * (n - 1))."""
    return (F.lit(float(q)) * (F.col("n") - 1)).cast("bigint")


def upper_median() -> Column:
    return F.floor(F.col("n") / 2)


def split_grid(rows: DataFrame) -> DataFrame:
    """Rows by split and category, with totals (null) of both."""
    return rows.cube("split", "category").agg(F.count(F.lit(1)).alias("n_rows"))


def coverage(rows: DataFrame) -> DataFrame:
    """Breaks in windows, distinct breaks covered, anchors that can't be found again."""
    spread = rows.select("record_id", F.explode_outer("breaks_global").alias("b"))
    distinct = spread.where("b is not null").agg(F.count_distinct("record_id", "b").alias("n_covered"))
    return rows.agg(F.coalesce(F.sum("n_breaks"), F.lit(0)).alias("n_breaks"), F.coalesce(F.sum("n_anchors_unlocatable"), F.lit(0)).alias("n_unlocatable"), F.count_if("was_clipped").alias("n_clipped"), F.count(F.lit(1)).alias("n_rows")).crossJoin(distinct)


def most_common(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def decision_weights(rows: DataFrame, share: float, weight: float = 1.0) -> DataFrame:
    """rows with decision_weight: classes weighed so that transitions have a share of the total, which stays the same."""
    is_a = F.col("category") == "true_transition"
    counts = rows.agg(F.count_if(is_a).alias("_a"), F.count_if(~is_a).alias("_c"))
    even = (F.col("_a") == 0) | (F.col("_c") == 0) | F.lit(share <= 0)
    n = F.col("_a") + F.col("_c")
    own = F.when(is_a, F.lit(float(share)) / F.col("_a")).otherwise(F.lit(1.0 - share) / F.col("_c"))
    return rows.crossJoin(F.broadcast(counts)).withColumn("decision_weight", F.when(even, F.lit(float(weight))).otherwise(own * F.lit(float(weight)) * n)).drop("_a", "_c")


def hard_weights(rows: DataFrame, errors: DataFrame, weight: float) -> DataFrame:
    """rows with row_weight: raised where a window holds a mined error (record_id, word_offset)."""
    by_record = errors.groupBy("record_id").agg(F.collect_set("word_offset").alias("_errors"))
    hit = F.exists("_errors", lambda o: (o >= F.col("win_word_start")) & (o < F.col("win_word_end")))
    return rows.join(by_record, "record_id", "left").withColumn("row_weight", F.when(F.coalesce(hit, F.lit(False)), F.lit(float(weight))).otherwise(F.lit(1.0))).drop("_errors")


def mine_errors(aligned: DataFrame, tolerance: int = 25, context: int = 60) -> DataFrame:
    """One row for each unmatched boundary: kind, word_offset, nearest (distance to the other side, null if it is empty), text_before, text_after.

    aligned: record_id, body, breaks, pred_breaks.  Which boundaries were matched goes by value: where a matched value repeats, none of its copies is an error.
    """
    base = aligned.withColumns({"breaks": F.array_sort("breaks"), "pred_breaks": F.array_sort("pred_breaks")})
    m = T.pin(metrics.match_documents(base, tolerance).withColumn("_words", scan.words(F.col("body"))), _w=F.col("_words")).drop("_words")
    away = lambda x, others: F.array_min(F.transform(others, lambda o: F.abs(x - o)))
    missed = F.filter("breaks", lambda b: ~F.array_contains(F.col("match.pairs.gold"), b))
    extra = F.filter("pred_breaks", lambda b: ~F.array_contains(F.col("match.pairs.pred"), b))
    errors = F.concat(
        F.transform(extra, lambda b: F.struct(F.lit("false_positive").alias("kind"), b.cast("bigint").alias("word_offset"), away(b, F.col("breaks")).cast("bigint").alias("nearest"))),
        F.transform(missed, lambda b: F.struct(F.lit("false_negative").alias("kind"), b.cast("bigint").alias("word_offset"), away(b, F.col("pred_breaks")).cast("bigint").alias("nearest"))),
    )
    keep = [c for c in aligned.columns if c not in ("body", "breaks", "pred_breaks", "present")]
    rows = m.select(*keep, "_w", F.explode(errors).alias("e")).select(*keep, "_w", "e.*")
    around = T.context(F.col("_w"), F.col("word_offset").cast("int"), context)
    return rows.withColumn("_x", around).select(*keep, "kind", "word_offset", "nearest", F.col("_x.before").alias("text_before"), F.col("_x.after").alias("text_after"))


def review_events(aligned: DataFrame, tolerance: int = 25) -> DataFrame:
    """record_id and its events (at, kind, gold, model, off) in order of position."""
    base = aligned.withColumns({"breaks": F.array_sort("breaks"), "pred_breaks": F.array_sort("pred_breaks")})
    m = metrics.match_documents(base, tolerance)
    event = lambda at, kind, g, p, off: F.struct(at.cast("bigint").alias("at"), F.lit(kind).alias("kind"), g.cast("bigint").alias("gold"), p.cast("bigint").alias("model"), off.cast("bigint").alias("off"))
    none = F.lit(None)
    events = F.concat(
        F.transform("match.pairs", lambda x: event(F.least(x["gold"], x["pred"]), "match", x["gold"], x["pred"], F.abs(x["gold"] - x["pred"]))),
        F.transform(F.filter("breaks", lambda b: ~F.array_contains(F.col("match.pairs.gold"), b)), lambda b: event(b, "missed", b, none, none)),
        F.transform(F.filter("pred_breaks", lambda b: ~F.array_contains(F.col("match.pairs.pred"), b)), lambda b: event(b, "extra", none, b, none)),
    )
    return m.select("record_id", *[c for c in ("body",) if c in aligned.columns], F.array_sort(events).alias("events"))


def picks(rows: DataFrame, record_ids: list[str]) -> DataFrame:
    """The rows of an ordered list of records, with their place in it."""
    chosen = rows.sparkSession.createDataFrame([(r, i) for i, r in enumerate(record_ids)], "record_id string, ordinal int")
    return rows.join(chosen, "record_id")
