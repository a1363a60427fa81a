"""How the segments of one run relate to those of another."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.arrays import best_first, keyed, offsets_of, spread
from newsloom.operators.segments import group_by_record, require_full
from newsloom.session import ship

STABLE = ("same", "moved")
_FIELDS = ("index", "segment_id", "word_start", "word_end", "n_words")
_SIDE = "array<struct<index:bigint,segment_id:string,word_start:bigint,word_end:bigint,n_words:bigint>>"
_OUT = "record_id string, ordinal int, status string, old_id string, new_id string, overlap double, start_shift bigint"


class _Side:
    """The segments of all records of a batch, in one row of arrays."""

    def __init__(self, lists: pa.Array):
        parts = lists.flatten()
        self.id = parts.field("segment_id")
        self.start, self.end, self.words = (parts.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("word_start", "word_end", "n_words"))
        self.at = offsets_of(lists)
        self.row = np.repeat(np.arange(len(lists)), np.diff(self.at))

    def __len__(self) -> int:
        return len(self.row)

    def ascending(self) -> bool:
        inside = self.row[1:] == self.row[:-1]
        return not (inside & ((self.start[1:] < self.start[:-1]) | (self.end[1:] < self.end[:-1]))).any()


def _met(o: _Side, n: _Side, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one record whose ranges overlap or touch; all pairs if wanted, or if segments aren't in the order of their words."""
    if every or not (o.ascending() and n.ascending()):
        first, count = n.at[o.row], np.diff(n.at)[o.row]
    else:
        low = int(min(n.start.min(initial=0), n.end.min(initial=0))) - 1
        width = int(max(n.start.max(initial=0), n.end.max(initial=0))) - low + 2
        first = np.searchsorted(keyed(n.row, n.end, low, width), keyed(o.row, o.start, low, width))
        count = np.maximum(np.searchsorted(keyed(n.row, n.start, low, width), keyed(o.row, o.end, low, width), "right") - first, 0)
    return spread(first, count)


def _hosts(part: np.ndarray, other: np.ndarray, inter: np.ndarray, size: int) -> np.ndarray:
    """For each part the place of the first pair of those that share most with it, -1 if there is none."""
    out = np.full(size, -1)
    order = np.lexsort((other, -inter, part))
    first = order[np.append(True, part[order][1:] != part[order][:-1])] if len(order) else order
    out[part[first]] = first
    return out


def _relate(batch: pa.RecordBatch, min_overlap: float, min_fragment: float) -> pa.RecordBatch:
    o, n = _Side(batch.column(1)), _Side(batch.column(2))
    x, y = _met(o, n, min_overlap <= 0 or min_fragment <= 0)
    inter = np.maximum(np.minimum(o.end[x], n.end[y]) - np.maximum(o.start[x], n.start[y]), 0)
    union = (o.end - o.start)[x] + (n.end - n.start)[y] - inter
    same = (o.start[x] == n.start[y]) & (o.end[x] == n.end[y])
    jaccard = np.where(union != 0, inter / np.where(union != 0, union, 1), same.astype(float))
    inter = np.where(union != 0, inter, 0)
    # how much of one lies in the other is measured against its own words
    in_new = (o.words[x] != 0) & (inter >= min_fragment * o.words[x])
    in_old = (n.words[y] != 0) & (inter >= min_fragment * n.words[y])
    near = np.flatnonzero(jaccard >= min_overlap)
    order = near[np.lexsort((y[near], x[near], -jaccard[near], o.row[x[near]]))]
    pairs = np.sort(order[best_first(np.arange(len(order)), x[order], y[order])])
    pairs = pairs[np.lexsort((y[pairs], x[pairs]))]
    parts = np.bincount(x[in_old], minlength=len(o))[x[pairs]] - in_old[pairs]
    joined = np.bincount(y[in_new], minlength=len(n))[y[pairs]] - in_new[pairs]
    status = np.select([parts > 0, joined > 0, same[pairs]], ["split", "merged", "same"], "moved").astype(object)
    lone_o = np.setdiff1d(np.arange(len(o)), x[pairs])
    lone_n = np.setdiff1d(np.arange(len(n)), y[pairs])
    held, holds = np.flatnonzero(in_new), np.flatnonzero(in_old)
    to = _hosts(x[held], y[held], inter[held], len(o))[lone_o]
    of = _hosts(y[holds], x[holds], inter[holds], len(n))[lone_n]
    # pairs, then old segments alone, then new ones; a host that isn't there is null
    at_o, at_n = held[to] if len(held) else to * 0, holds[of] if len(holds) else of * 0
    pick = lambda values, at, has: np.where(has, values[at] if len(values) else 0, -1)
    old = np.concatenate([x[pairs], lone_o, pick(x, at_n, of >= 0)])
    new = np.concatenate([y[pairs], pick(y, at_o, to >= 0), lone_n])
    status = np.concatenate([status, np.where(to >= 0, "merged", "removed").astype(object), np.where(of >= 0, "split", "added").astype(object)])
    overlap = np.concatenate([jaccard[pairs], np.where(to >= 0, jaccard[at_o] if len(jaccard) else 0, 0.0), np.where(of >= 0, jaccard[at_n] if len(jaccard) else 0, 0.0)])
    kind = np.repeat([0, 1, 2], [len(pairs), len(lone_o), len(lone_n)])
    row = np.concatenate([o.row[x[pairs]], o.row[lone_o], n.row[lone_n]]).astype(np.int64)
    out = np.lexsort((np.arange(len(row)), kind, row))
    row, old, new, status, overlap = row[out], old[out].astype(np.int64), new[out].astype(np.int64), status[out], overlap[out]
    both = (old >= 0) & (new >= 0)
    shift = np.where(both, (n.start[new] if len(n) else 0) - (o.start[old] if len(o) else 0), 0)
    ids = lambda side, at: side.id.take(pa.array(np.maximum(at, 0), mask=at < 0)) if len(side) else pa.nulls(len(at), pa.string())
    ordinal = np.arange(len(row)) - np.searchsorted(row, row)
    columns = [batch.column(0).take(pa.array(row)), pa.array(ordinal.astype(np.int32)), pa.array(status, pa.string()), ids(o, old), ids(n, new), pa.array(overlap), pa.array(shift, pa.int64(), mask=~both)]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _OUT.split(", ")])


def reconcile(old: DataFrame, new: DataFrame, min_overlap: float = 0.5, min_fragment: float = 0.5) -> DataFrame:
    """record_id, ordinal, status, old_id, new_id, overlap, start_shift.

    Segments are paired one-to-one, highest Jaccard overlap first, then by
    position.  Pairs come first, then unpaired old segments (merged into the new
    one that holds most of them, or removed), then unpaired new ones (split off,
    or added); nothing is dropped.  One shuffle by record on each side; then only
    segments whose ranges meet are looked at, found by bisection, for all records of
    a batch at once.  With a min_overlap or min_fragment of 0 every pair of a record counts.
    """
    ship(old.sparkSession)

    def side(df: DataFrame, name: str) -> DataFrame:
        grouped = group_by_record(require_full(df), _FIELDS)
        whole = F.transform("segments", lambda s: F.struct(*[s[c].cast("string" if c == "segment_id" else "bigint").alias(c) for c in _FIELDS]))
        return grouped.select("record_id", whole.alias(name))

    none = F.array().cast(_SIDE)
    both = side(old, "o").join(side(new, "n"), "record_id", "full").select(F.col("record_id").cast("string").alias("record_id"), F.coalesce("o", none).alias("o"), F.coalesce("n", none).alias("n"))

    def stage(batches):
        for batch in batches:
            if len(batch):
                yield _relate(batch, float(min_overlap), float(min_fragment))

    return both.mapInArrow(stage, _OUT)


def id_map(correspondences: DataFrame) -> DataFrame:
    """old_id, new_id of one-to-one correspondences; of a repeated old_id the later row counts."""
    stable = correspondences.where(F.col("status").isin(*STABLE) & (F.col("old_id") != "") & (F.col("new_id") != ""))
    return stable.groupBy("old_id").agg(F.max_by("new_id", F.struct("record_id", "ordinal")).alias("new_id"))


def status_counts(correspondences: DataFrame) -> DataFrame:
    return correspondences.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def shifts(correspondences: DataFrame) -> DataFrame:
    """How many boundaries of stable pairs moved, and by how many words at most."""
    moved = correspondences.where(F.col("status").isin(*STABLE) & (F.col("start_shift") != 0))
    return moved.agg(F.count(F.lit(1)).alias("n_moved"), F.max(F.abs("start_shift")).alias("max_shift"))
