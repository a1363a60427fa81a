"""Array functions that built-in ones give in quadratic time only.

Each works on the flat values of a whole Arrow batch, in no loop over rows, and
costs a sort of them at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from newsloom.session import ship


def offsets_of(lists: pa.Array) -> np.ndarray:
    """The n + 1 offsets of lists in their joined values; a null list is empty."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.append(0, np.cumsum(size)).astype(np.int64)


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists (nulls as 0), and their offsets."""
    values = lists.flatten()
    if values.null_count:
        values = pc.fill_null(values, 0)
    return values.to_numpy(zero_copy_only=False).astype(np.int64), offsets_of(lists)


def lists_of(values: pa.Array, offsets: np.ndarray, like: pa.Array | None = None) -> pa.Array:
    """Lists of the values, null where `like` is."""
    mask = pc.is_null(like) if like is not None and like.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=mask)


def _apply(kind: str, f, *columns: Column) -> Column:
    ship(SparkSession.active())
    return F.arrow_udf(f, kind)(*columns)


def running_sum(values: Column) -> Column:
    """array<bigint>: of each element the sum up to it."""

    def summed(lists: pa.Array) -> pa.Array:
        own, offsets = flat(lists)
        total = np.append(0, np.cumsum(own))
        return lists_of(pa.array(total[1:] - np.repeat(total[offsets[:-1]], np.diff(offsets))), offsets, lists)

    return _apply("array<bigint>", summed, values)


def chain_means(values: Column, radius: int) -> Column:
    """array<bigint>: of each chain of values no more than `radius` apart the mean, rounded half to even; ascending."""

    def chained(lists: pa.Array) -> pa.Array:
        own, offsets = flat(lists)
        row = np.repeat(np.arange(len(lists)), np.diff(offsets))
        order = np.lexsort((own, row))
        own, row = own[order], row[order]
        new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (own[1:] - own[:-1] > radius))) if len(own) else row
        total = np.append(0, np.cumsum(own))
        ends = np.append(new[1:], len(own))
        mean = np.rint((total[ends] - total[new]) / (ends - new)) if len(new) else own
        return lists_of(pa.array(mean.astype(np.int64)), np.searchsorted(row[new], np.arange(len(lists) + 1)), lists)

    return _apply("array<bigint>", chained, values)


def keyed(row: np.ndarray, value: np.ndarray, low: int, width: int) -> np.ndarray:
    """One number for each row and value that is in the order of both; values are clipped to [low, low + width)."""
    return row * width + np.clip(value - low, 0, width - 1)


def bisect_left(ascending: Column, values: Column) -> Column:
    """array<int>: how many elements of an ascending array are less than each of the values."""

    def found(lists: pa.Array, wanted: pa.Array) -> pa.Array:
        own, at = flat(lists)
        ask, offsets = flat(wanted)
        rows = np.arange(len(lists))
        low = int(own.min(initial=0)) - 1
        width = int(own.max(initial=0)) - low + 2
        keys = keyed(np.repeat(rows, np.diff(at)), own, low, width)
        asking = np.repeat(rows, np.diff(offsets))
        count = np.searchsorted(keys, keyed(asking, ask, low, width)) - at[asking]
        return lists_of(pa.array(count.astype(np.int32)), offsets, wanted)

    return _apply("array<int>", found, ascending, values)


def best_first(order: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places in `order` of the pairs (left, right) that are taken when they are gone through in order and each side is used once.

    A pair that comes first for both of its sides is taken whatever the others do, so all of these are taken at once.
    """
    left, right = left[order], right[order]
    open_ = np.arange(len(order))
    used_left, used_right = np.zeros(left.max(initial=-1) + 1, bool), np.zeros(right.max(initial=-1) + 1, bool)
    taken = []
    while len(open_):
        first = [np.isin(np.arange(len(open_)), np.unique(side[open_], return_index=True)[1]) for side in (left, right)]
        now = open_[first[0] & first[1]]
        taken.append(now)
        used_left[left[now]] = used_right[right[now]] = True
        open_ = open_[~(used_left[left[open_]] | used_right[right[open_]])]
    return np.sort(np.concatenate(taken)) if taken else open_


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges of so many places from `first` on: the range and the place of each."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.repeat(first, count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)


def match_nearest(gold: Column, pred: Column, tolerance: Column) -> Column:
    """array<struct<g, p>>: indices of boundaries paired one-to-one within a tolerance, nearest first, then by index."""

    def matched(golds: pa.Array, preds: pa.Array, tolerances: pa.Array) -> pa.Array:
        g, g_at = flat(golds)
        p, p_at = flat(preds)
        most = tolerances.to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.arange(len(golds))
        g_row, p_row = np.repeat(rows, np.diff(g_at)), np.repeat(rows, np.diff(p_at))
        low = int(p.min(initial=0)) - 1
        width = int(p.max(initial=0)) - low + 2
        by_value = np.lexsort((p, p_row))
        keys = keyed(p_row, p, low, width)[by_value]
        reach = most[g_row]
        begin = np.searchsorted(keys, keyed(g_row, g - reach, low, width))
        count = np.where(reach >= 0, np.searchsorted(keys, keyed(g_row, g + reach, low, width), "right") - begin, 0)
        left, place = spread(begin, count)
        right = by_value[place]
        # by number in its row; sorted by row, distance and both indices
        order = np.lexsort((right, left, np.abs(g[left] - p[right]), g_row[left]))
        kept = order[best_first(order, left, right)]
        row = g_row[left[kept]]
        pairs = pa.StructArray.from_arrays([pa.array((side[kept] - at[row]).astype(np.int32)) for side, at in ((left, g_at), (right, p_at))], ["g", "p"])
        return lists_of(pairs, np.searchsorted(row, np.arange(len(golds) + 1)))

    return _apply("array<struct<g:int,p:int>>", matched, gold, pred, tolerance)
