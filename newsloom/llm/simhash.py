"""Near-duplicate groups by SimHash (operator 1).

A document's fingerprint has 128 bits: the signs of the sums, over its distinct
terms (lower-cased runs of letters and digits), of a hash's bits, a term
weighing its length up to 10.  Two documents are linked if their fingerprints
differ in at most `most_bits` bits; groups are the connected components.

Search.  The range join is exact: every pair within `most_bits` is found.  The
128 bits are cut into bands, and band k is given e_k errors so that the sum of
e_k + 1 is most_bits + 1; a pair that differs in more than e_k bits of each band
k would differ in more than `most_bits`.  So each link shows in some band whose
values differ in at most e_k bits.  The rows of each value of a band are compared
with those of every value within e_k bits: with 8 bands 15 in 1,000 of all pairs
at 22 bits.  Many narrow bands have few values and compare many pairs, few wide
ones the reverse; a task takes the cut that costs less for its rows.  Each pair is held against the exact Hamming distance, so there are no
false links, and is counted in the first band that it shows in, which the two
fingerprints alone tell.

Fingerprints are dealt to blocks by a hash, and each pair of blocks (a block with
itself too) is a task, so that no value however frequent makes a task larger.
The work grows with the square of the number of fingerprints, as an exact search
at this distance does; nothing is sampled or capped.  No list of pairs is written:
a task returns the least member of each of its own components, and the links of
each member.  Equal fingerprints are joined once, by equality.

Cases.  Null, empty or term-free texts and rows with a null id have no
fingerprint and belong to no group.  A doc_id that repeats is one document; one
with different texts links the groups of all of them.  Ties: the least doc_id of
a group is the one that stays.  An empty table has no groups.  Other columns of
the input are not looked at.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import vectext as V
from newsloom.llm.common import Tables, documents, id_text

BITS = 128
#: A pair of fingerprints that differ in so many bits is still a near duplicate.
MOST_BITS = 22
#: Rows of a block at most; small tables are cut into up to BLOCKS blocks of LEAST rows, to occupy all cores.
MOST, BLOCKS, LEAST = 1 << 19, 6, 1 << 12
#: Numbers of bands to choose from, and what a value of a band and a comparison cost, in nanoseconds.
CUTS, VALUE, COMPARE = (8, 10, 12, 14, 16), 30000.0, 3.0
#: Pairs that are compared at a time.
PAIRS = 1 << 16
SLICE = 1 << 20


def fingerprint_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An (n, 2) array of uint64, and which rows have any term."""
    raw, offsets, start, end, row = V.terms(column)
    n = len(offsets) - 1
    out, has = np.zeros((n, BITS // 64), np.uint64), np.zeros(n, bool)
    bounds = np.searchsorted(start, offsets)
    for i, j in V.slices(offsets, SLICE):
        a, b = bounds[i], bounds[j]
        if a == b:
            continue
        h = V.hashes(raw, start[a:b], end[a:b])
        weight = np.minimum(end[a:b] - start[a:b], 10).astype(np.uint64)
        key = np.sort((row[a:b] - i).astype(np.uint64) << np.uint64(44) | (h >> np.uint64(24)) << np.uint64(4) | weight)
        key = key[np.append(True, key[1:] != key[:-1])]
        at = (key >> np.uint64(44)).astype(np.int64)
        weight = (key & np.uint64(15)).astype(np.float32)
        term = key >> np.uint64(4) & np.uint64((1 << 40) - 1)
        rows, first = np.unique(at, return_index=True)
        last = np.append(first[1:], len(at))
        has[i + rows] = True
        for q in range(BITS // 64):
            bits = np.unpackbits(V.mix(term + np.uint64((q + 1) * 0x9E3779B97F4A7C15 % 2**64)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            votes = np.empty((len(rows), 64), np.float32)
            for k in range(len(rows)):
                x, y = first[k], last[k]
                votes[k] = 2 * (weight[x:y] @ bits[x:y]) - weight[x:y].sum()
            out[i + rows, q] = np.packbits(votes > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out, has


def _stage(batches):
    for batch in batches:
        f, has = fingerprint_arrays(batch.column(1))
        keep = pa.array(has)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f[:, 0].view(np.int64)), pa.array(f[:, 1].view(np.int64))], ["doc_id", "f0", "f1"]).filter(keep)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, f0, f1 of each row that has an id and a term."""
    return id_text(docs, id_col, text_col).where("doc_id is not null and text is not null").mapInArrow(_stage, "doc_id bigint, f0 bigint, f1 bigint")


def bands(most_bits: int, number: int) -> list[tuple[int, int, int, int]]:
    """(word, shift, width, errors) of an even number of bands; pairs within most_bits are within the errors of one of them."""
    half, out = number // 2, []
    for word in range(2):
        edges = [BITS // 2 * k // half for k in range(half + 1)]
        out += [(word, low, high - low) for low, high in zip(edges, edges[1:], strict=False)]
    each, more = divmod(most_bits + 1, number)
    # the widest bands take the errors that are left over
    wide = sorted(range(number), key=lambda k: -out[k][2])[:more]
    return [(*band, min(each - (k not in wide), band[2])) for k, band in enumerate(out)]


@lru_cache(maxsize=64)
def flips(width: int, errors: int) -> np.ndarray:
    """All values of so many bits of which at most `errors` are set; 0 comes first."""
    values = np.arange(1 << width, dtype=np.uint32)
    return values[np.bitwise_count(values) <= errors] if errors >= 0 else values[:0]


def cut(most_bits: int, left: int, right: int) -> list[tuple[int, int, int, int]]:
    """The bands by which so many rows are compared with so many others at the least cost."""

    def cost(number: int) -> float:
        near = [(sum(math.comb(w, k) for k in range(e + 1)), w) for _, _, w, e in bands(most_bits, number)]
        return sum(min(left, 2**w) * VALUE + left * right * n / 2**w * COMPARE for n, w in near if n)

    return bands(most_bits, min(CUTS, key=cost))


def _within(x: np.ndarray, band: tuple[int, int, int, int]) -> np.ndarray:
    """Whether differences (n, 2) have at most the band's errors in it."""
    word, shift, width, errors = band
    part = x[:, word] >> np.uint64(shift) & np.uint64((1 << width) - 1)
    return np.bitwise_count(part).astype(np.int16) <= errors


def _candidates(left: np.ndarray, right: np.ndarray, other: tuple[np.ndarray, np.ndarray], width: int, errors: int, most_bits: int, same: bool):
    """Yields pairs of places in two sorted arrays of values that differ in at most so many bits, if the other words are within most_bits; of one array with itself each once."""
    count = np.bincount(right, minlength=1 << width)
    start = np.cumsum(count) - count
    near = flips(width, errors)
    edges = np.append(np.flatnonzero(np.append(True, left[1:] != left[:-1])), len(left)) if len(left) and len(near) else np.zeros(1, np.int64)
    place = np.arange(len(right))
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        cells = near ^ left[x]
        if same:
            cells = cells[cells >= left[x]]
        many = count[cells]
        ends = np.cumsum(many)
        total = int(ends[-1])
        if not total:
            continue
        at = np.repeat(start[cells] - ends + many, many) + place[:total]
        theirs = other[1][at]
        for i in range(0, total, PAIRS):
            own = theirs[i : i + PAIRS]
            step = PAIRS // len(own)
            for k in range(x, y, step):
                hit = np.flatnonzero(np.bitwise_count(other[0][k : min(k + step, y), None] ^ own) <= most_bits)
                if len(hit):
                    a, b = np.divmod(hit, len(own))
                    a, b = a + k, at[b + i]
                    yield (a[a < b], b[a < b]) if same else (a, b)


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the place of a lesser member, roots their own) after the links a - b."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def links(f: np.ndarray, most_bits: int, block: np.ndarray | None = None, cuts: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct fingerprints (n, 2): the place of the least one of each one's component, and the number of its links; with blocks (True and False) of those across them."""
    n = len(f)
    left = np.arange(n) if block is None else np.flatnonzero(block)
    right = left if block is None else np.flatnonzero(~block)
    label, degree = np.arange(n), np.zeros(n, np.int64)
    cuts = cuts or cut(most_bits, len(left), len(right))
    for k, (word, shift, width, errors) in enumerate(cuts):
        value = (f[:, word] >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)
        l, r = (own[np.argsort(value[own], kind="stable")] for own in (left, right))
        # the other word is compared first: it is the one that rarely agrees
        found = _candidates(value[l], value[r], (f[l, 1 - word], f[r, 1 - word]), width, errors, most_bits, block is None)
        for a, b in _gathered(found):
            a, b = l[a], r[b]
            x = f[a] ^ f[b]
            keep = np.bitwise_count(x).sum(1, dtype=np.int16) <= most_bits
            a, b, x = a[keep], b[keep], x[keep]
            for before in cuts[:k]:
                fresh = ~_within(x, before)
                a, b, x = a[fresh], b[fresh], x[fresh]
            if len(a):
                degree += np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
                label = join(label, a, b)
    return label, degree


def _gathered(pairs):
    """The pairs of arrays, in arrays of about PAIRS."""
    held, kept = [], 0
    for a, b in pairs:
        held.append((a, b))
        kept += len(a)
        if kept >= PAIRS:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, kept = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def near(distinct: DataFrame, n: int, most_bits: int = MOST_BITS, most: int = MOST) -> DataFrame:
    """node, least (another or the same), links: rows whose sums of links and whose components are those of representatives of distinct fingerprints (rep, f0, f1)."""
    blocks = max(1, math.ceil(n / most), min(BLOCKS, math.ceil(n / LEAST)))
    # a row goes to the tasks of its block with every block
    rows = distinct.select("rep", "f0", "f1", F.pmod(F.xxhash64("f0", "f1"), F.lit(blocks)).cast("int").alias("own"))
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("rep", "f0", "f1", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), "own")

    def stage(key: tuple, table: pa.Table) -> pa.Table:
        i, j = (x.as_py() for x in key)
        # the least place is the least representative
        order = np.argsort(table["rep"].to_numpy())
        rep, own = table["rep"].to_numpy()[order], table["own"].to_numpy()[order]
        f = np.stack([table[c].to_numpy().view(np.uint64)[order] for c in ("f0", "f1")], axis=1)
        label, degree = links(f, most_bits, None if i == j else own == i)
        has = degree > 0
        return pa.table({"node": rep[has], "least": rep[label[has]], "links": degree[has]})

    # a stated number of partitions, which isn't reduced for being small: the work is in the tasks
    return rows.repartition(blocks * (blocks + 1), "i", "j").groupBy("i", "j").applyInArrow(stage, "node bigint, least bigint, links bigint")


def components(spark: SparkSession, tables: Tables, edges: DataFrame) -> DataFrame:
    """A table of stars (a, b): each node a of the edges (a, b) but the least one of its component, and that one.

    Alternating large and small stars; the edges are written after each round, and rounds end when all are stars: no node has two edges up, or one up and one down.
    """
    edges = tables.put(edges.select("a", "b"))
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("b"), F.col("b").alias("a"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        fresh = tables.put(small)
        tables.drop(edges)
        edges = fresh
        # edges are distinct here, and a is the greater one
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty():
            return edges


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS, most: int = MOST) -> DataFrame:
    """doc_id, group_id (the least doc_id), group_size, n_links (other fingerprints that its own is linked to), keep: the documents of groups of two and more."""
    spark = docs.sparkSession
    tables = Tables(spark, "simhash")
    prints = tables.put(fingerprints(docs, id_col, text_col))
    distinct = tables.put(prints.groupBy("f0", "f1").agg(F.min("doc_id").alias("rep"), (F.max("doc_id") > F.min("doc_id")).alias("copies")))
    met = tables.put(near(distinct.select("rep", "f0", "f1"), distinct.count(), most_bits, most))
    owners = tables.put(prints.join(distinct, ["f0", "f1"]).select("doc_id", "rep").distinct())
    # an id with several texts links what these belong to
    several = owners.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("m")).where("b < m").select("doc_id", "b")
    edges = met.select(F.col("node").alias("a"), F.col("least").alias("b")).union(owners.join(several, "doc_id").select(F.col("rep").alias("a"), "b")).where("a <> b").distinct()
    stars = components(spark, tables, edges)
    least = stars.select(F.col("a").alias("node"), F.col("b").alias("least")).union(stars.select("b", "b")).distinct()
    degree = met.groupBy(F.col("node").alias("rep")).agg(F.sum("links").alias("n_links"))
    labels = distinct.groupBy("rep").agg(F.max("copies").alias("copies")).join(least, F.col("rep") == F.col("node"), "left").where("copies or node is not null").select("rep", F.coalesce("least", "rep").alias("group_id")).join(degree, "rep", "left")
    members = owners.join(labels, "rep").groupBy("doc_id").agg(F.min("group_id").alias("group_id"), F.coalesce(F.sum("n_links"), F.lit(0)).alias("n_links"))
    sizes = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"))
    out = tables.put(members.join(sizes, "group_id").where("group_size > 1").select("doc_id", "group_id", "group_size", "n_links", (F.col("doc_id") == F.col("group_id")).alias("keep")))
    tables.drop(prints, distinct, met, owners, stars)
    return out


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of docs but for those whose document isn't the kept one of its group."""
    gone = groups(docs, id_col, text_col, most_bits).where("not keep").select(F.col("doc_id").alias("_gone_id"))
    return docs.join(gone, docs[id_col].cast("bigint") == gone["_gone_id"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir))


SQL = None
