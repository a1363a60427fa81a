"""Mixing sources to target weights by a hypergeometric splitting tree (operator 10).

The unit is a document key (source, doc_id).  Keys are permuted within their
source by a keyed hash and cut into blocks of BLOCK keys; the last block of a
source may be smaller.  The quotas are exact.  A target size is shared out by the
weights; a source that has less gives all it has, and the others make up for it
by their weights (water-filling, largest remainders).  Weights without a target
are kept exactly, in whole blocks: the largest number of blocks N such that no
source is asked for more than it has.  The quota vector is
split over the output shards by a binary tree: a node with m shards gives m // 2
of them that part of its blocks, drawn by a multivariate hypergeometric
distribution, so that every shard has its exact size (to one block) and a random
composition whose sum over shards is the quota.  Each node draws from a random
stream of its own, so that subtrees are independent: the driver splits down to
nodes of LEAF shards, and tasks split the rest.  Since the hash has permuted the
documents before blocks were cut, taking a source's blocks in order is drawing
disjoint blocks at random; the smaller last block of a source makes its shard
smaller by what it lacks.  Within a shard rows are shuffled by a second hash.

Plan.  Only (source, id, hash) is shuffled for ranking, in hash buckets whose
number grows with the table, so that a hot source isn't one task.  Where each shard begins in each source becomes a
hash bound, and a row finds its shard from its own hash by a look-up table of
buckets (broadcast if it has at most BROADCAST entries, joined otherwise).  Texts are
shuffled once, to their shards.  The driver holds one number for each source and leaf of the tree.

Without weights, a source's weight is its number of keys to the power
TEMPERATURE over that of all.  Without a target either, each source is asked for
its weight's share of as many keys as the input has and gives what it has of
that: no source bounds another, small sources stay whole, equal sources give all,
and only sources above their weight are thinned out to it.

Cases.  A null source is a source of its own.  Rows with a null id are left out:
they can't be drawn reproducibly.  Rows that repeat a key travel together and
count once.  A source of weight 0 or without a weight is left out, and so is one
of less than a block if weights are given without a target; a target beyond what
there is draws all.  An empty input gives an empty result.  Columns named mix_shard or mix_position are
replaced; others are returned as they are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import Tables, documents, plain

TEMPERATURE, BLOCK, SHARD, SEED = 0.7, 4, 4096, 1
#: Keys of a hash bucket in expectation, and buckets at least.
BUCKET, BUCKETS = 1 << 14, 256
#: Shards of a node of the tree that a task splits; blocks in all, beyond which they are made larger (the draw's exact range).
LEAF, BLOCKS = 1024, 1 << 29
#: Entries of the look-up table up to which it is broadcast.
BROADCAST = 1 << 18


def quotas(blocks: dict[str, int], weights: dict[str, float]) -> dict[str, int]:
    """Exact numbers of blocks by source."""
    share = {s: w for s, w in weights.items() if w > 0 and blocks.get(s, 0) > 0}
    if not share:
        return {}
    total = sum(share.values())
    share = {s: w / total for s, w in share.items()}
    n = math.floor(min(blocks[s] / w for s, w in share.items()) + 1e-9)
    out = {s: min(math.floor(n * w + 1e-9), blocks[s]) for s, w in share.items()}
    rest = sorted(share, key=lambda s: (out[s] - n * share[s], s))
    for s in rest:
        if sum(out.values()) >= n:
            break
        if out[s] < blocks[s]:
            out[s] += 1
    return out


def fill(sizes: dict[str, int], weights: dict[str, float], target: int) -> dict[str, int]:
    """Exact numbers of keys by source that add up to the target, or to all there are; what a source lacks, the others give by their weights."""
    share = {s: w for s, w in weights.items() if w > 0 and sizes.get(s, 0) > 0}
    left = min(target, sum(sizes[s] for s in share))
    order = sorted(share, key=lambda s: (sizes[s] / share[s], s))
    # the weight of a source and of all that run out after it
    behind = dict(zip(order, np.cumsum([share[s] for s in reversed(order)])[::-1].tolist(), strict=True))
    out: dict[str, int] = {}
    for k, s in enumerate(order):
        if sizes[s] * behind[s] > left * share[s]:
            exact = {x: left * share[x] / behind[s] for x in order[k:]}
            out |= {x: min(math.floor(v), sizes[x]) for x, v in exact.items()}
            left -= sum(out[x] for x in exact)
            for x in sorted(exact, key=lambda x: (out[x] - exact[x], x)):
                if left and out[x] < sizes[x]:
                    out[x], left = out[x] + 1, left - 1
            return out
        out[s], left = sizes[s], left - sizes[s]
    return out


def _nodes(quota: np.ndarray, first: int, m: int, shards: int, total: int, seed: int, leaf: int) -> list[tuple[int, int, np.ndarray]]:
    """The nodes (first shard, shards, blocks by source), of at most `leaf` shards, that a node falls apart into, in order."""
    out, todo = [], [(first, m, quota.astype(np.int64))]
    while todo:
        first, m, own = todo.pop()
        if m <= leaf:
            out.append((first, m, own))
            continue
        left = m // 2
        # shard i of all holds blocks [i * total // shards, (i + 1) * total // shards)
        size = (first + left) * total // shards - first * total // shards
        rng = np.random.Generator(np.random.PCG64([seed, first, m]))
        part = rng.multivariate_hypergeometric(own, size) if own.sum() else own * 0
        todo += [(first + left, m - left, own - part), (first, left, part)]
    return out


def split(quota: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """(shards, sources) blocks; rows differ by at most one in size, columns sum to the quota."""
    return np.array([own for _, _, own in _nodes(quota, 0, shards, shards, int(quota.sum()), seed, 1)])


def _name(source: str | None) -> str:
    """A name for a source that tells null from every string."""
    return "null" if source is None else "=" + source


def _starts(spark: SparkSession, names: list[str], keys: np.ndarray, block: int, shards: int, seed: int) -> DataFrame:
    """src, rank, shard: the rank within each source at which each shard begins, and at which the last one ends."""
    quota = -(-keys // block)
    total = int(quota.sum())
    nodes = _nodes(quota, 0, shards, shards, total, seed, LEAF)
    before = np.cumsum([own for *_, own in nodes], axis=0)
    rows = spark.createDataFrame(pa.table({"first": [f for f, *_ in nodes], "m": [m for _, m, _ in nodes], "own": [own.tolist() for *_, own in nodes], "before": [(b - own).tolist() for b, (*_, own) in zip(before, nodes, strict=True)]}))

    def stage(batches):
        for batch in batches:
            for r in batch.to_pylist():
                parts = np.array([own for *_, own in _nodes(np.array(r["own"]), r["first"], r["m"], shards, total, seed, 1)])
                ends = np.array(r["before"]) + np.cumsum(parts, axis=0)
                # the last block of a source ends with its quota; a shard begins where the one before ends
                begin = np.minimum((ends - parts) * block, keys)
                shard = np.repeat(np.arange(r["first"], r["first"] + r["m"]), len(names))
                if r["first"] + r["m"] == shards:
                    begin, shard = np.vstack([begin, keys]), np.append(shard, np.full(len(names), shards))
                source = np.tile(np.arange(len(names)), len(begin))
                yield pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(source)), pa.array(begin.ravel()), pa.array(shard.astype(np.int32))], ["src", "rank", "shard"])

    return rows.repartition(max(1, min(len(nodes), 4096))).mapInArrow(stage, "src string, rank bigint, shard int")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK, shard: int = SHARD, seed: int = SEED, target: int | None = None) -> DataFrame:
    """The drawn rows of docs with mix_shard and mix_position (from 0, the shuffled order within the shard)."""
    spark = docs.sparkSession
    tables = Tables(spark, "mixing")
    names_out = [c for c in docs.columns if c.lower() not in ("mix_shard", "mix_position")]
    out_columns = [f"c{i}" for i, c in enumerate(docs.columns) if c in names_out]
    docs, (id_col, source_col) = plain(docs, id_col, source_col)
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    key, hashed = F.col(id_col).cast("bigint"), F.xxhash64(F.lit(SEED), F.col(id_col).cast("bigint"))
    keys = tables.put(docs.select(source.alias("src"), key.alias("id"), hashed.alias("h")).where("id is not null").distinct())
    shift = 64 - min(24, max((BUCKETS - 1).bit_length(), (keys.count() // BUCKET).bit_length()))
    keys_in = keys.withColumn("bucket", F.shiftright("h", shift))
    counted = keys_in.groupBy("src", "bucket").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = tables.put(counted.withColumn("before", F.coalesce(F.sum("n").over(own), F.lit(0))))
    found = before.groupBy("src").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("buckets")).collect()
    sizes, entries = {r["src"]: r["n"] for r in found}, sum(r["buckets"] for r in found)
    share = {_name(s): w for s, w in weights.items()} if weights else {s: n**TEMPERATURE for s, n in sizes.items()}
    block = max(block, -(-sum(sizes.values()) // BLOCKS))
    if weights and target is None:
        quota = {s: n * block for s, n in quotas({s: n // block for s, n in sizes.items()}, share).items()}
    else:
        if target is None:
            each = sum(sizes.values()) / (sum(share.values()) or 1)
            target = round(sum(min(n, each * share[s]) for s, n in sizes.items()))
        quota = fill(sizes, share, target)
    names = sorted(s for s, n in quota.items() if n)
    named = lambda df: df.select(*out_columns, "mix_shard", "mix_position").toDF(*names_out, "mix_shard", "mix_position")
    total = sum(quota.values())
    if not total:
        return named(docs.select(*out_columns, F.lit(0).cast("int").alias("mix_shard"), F.lit(0).cast("bigint").alias("mix_position")).where("false"))
    shards = max(1, round(total / shard))
    wanted = _starts(spark, names, np.array([quota[s] for s in names]), block, shards, seed)
    rank = F.row_number().over(Window.partitionBy("src", "bucket").orderBy("h", "id")) - 1 + F.col("before")
    ranked = keys_in.join(before.select("src", "bucket", "before"), ["src", "bucket"]).withColumn("rank", rank)
    bounds = ranked.join(wanted, ["src", "rank"]).groupBy("src", "bucket", "h", "id").agg(F.max("shard").alias("shard"))
    # a bucket's own bounds, and the last one before it
    inside = bounds.groupBy("src", "bucket").agg(F.array_sort(F.collect_list(F.struct("h", "id", "shard"))).alias("bounds"), F.max("shard").alias("top"))
    look = before.select("src", "bucket").join(inside, ["src", "bucket"], "left")
    look = tables.put(look.select(F.col("src").alias("_mix_src"), F.col("bucket").alias("_mix_bucket"), F.coalesce(F.max("top").over(own), F.lit(-1)).alias("_mix_base"), F.coalesce("bounds", F.array().cast("array<struct<h:bigint,id:bigint,shard:int>>")).alias("_mix_bounds")))
    tables.drop(keys, before)
    if entries + len(names) * (shards + 1) <= BROADCAST:
        look = F.broadcast(look)
    rows = docs.select(*out_columns, source.alias("_mix_s"), key.alias("_mix_id"), hashed.alias("_mix_h")).where("_mix_id is not null")
    rows = rows.join(look, (F.col("_mix_s") == F.col("_mix_src")) & (F.shiftright("_mix_h", shift) == F.col("_mix_bucket")))
    passed = F.filter("_mix_bounds", lambda b: (b["h"] < F.col("_mix_h")) | ((b["h"] == F.col("_mix_h")) & (b["id"] <= F.col("_mix_id"))))
    rows = rows.withColumn("_mix_passed", passed).withColumn("mix_shard", F.when(F.size("_mix_passed") > 0, F.element_at("_mix_passed", -1)["shard"]).otherwise(F.col("_mix_base"))).where(f"mix_shard >= 0 and mix_shard < {shards}")
    order = Window.partitionBy("mix_shard").orderBy(F.xxhash64(F.lit(seed + 1), F.col("_mix_h")), "_mix_id")
    return named(rows.withColumn("mix_position", (F.row_number().over(order) - 1).cast("bigint")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


SQL = None
