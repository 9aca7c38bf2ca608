"""Uniform sharding by a hypergeometric communication matrix (native).

A uniform shuffle of rows into shards of exact sizes without sorting all rows:

1. every task numbers its own rows, permutes them by a keyed hash of the number
   and numbers them again; the task is the rows' block.  The numbered rows are written, so blocks and places
   stand whatever executor is lost later;
2. the block sizes are counted, and the number of rows that each block sends to
   each shard is drawn: the matrix of a uniform permutation of all rows, given
   blocks and shards, is multivariate hypergeometric.  Its rows sum to the block
   sizes and its columns to the shard sizes, exactly;
3. a block's first M[block, 0] rows go to shard 0, the next M[block, 1] to shard
   1, and so on: one exchange;
4. within a shard rows are permuted again by another keyed hash, in sub-buckets
   of about SLOT_ROWS rows, so no task sorts a whole shard; a sub-bucket's slots
   follow those before it.

The law is `rows`: shard sizes differ by one at most, the first shards being the
larger ones.  Everything is done with built-in functions; the driver draws the
matrix (blocks x shards integers, one block for each input task, whatever the
rows hold).

Keys are hashed from the seed and a row's number, never from what it holds, so equal texts,
null ids and repeated rows are spread like any others: no group of equal rows
ever meets in one task.  A null text has size 1 and the checksum of no bytes.
Empty input gives an empty result; fewer rows than shards leave shards empty.
Of clashing names among the columns carried, the operator's own wins.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, Window

from strata.llm import common

SHARDS = 16
SEED = 20_250_101
#: rows of a sub-bucket on average
SLOT_ROWS = 8192
#: blocks up to which the matrix is broadcast, and (shard, sub-bucket) pairs up to which their offsets are; more are joined by a shuffle
BROADCAST_ROWS = 20_000
OWN = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
_PLACE_BITS = 33  # of monotonically_increasing_id


def _log_ratio(n: int, p: float, k: int, mode: int) -> float:
    """log of Binomial(n, p) at k over its value at the mode."""
    f = lambda x: math.lgamma(x + 1) + math.lgamma(n - x + 1)
    return f(mode) - f(k) + (k - mode) * (math.log(p) - math.log1p(-p))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Good ones among `drawn` of good + bad, without replacement; of any size.

    Two binomials of equal rate that are accepted when they add up to `good`
    have this law: the first is drawn, and accepted with the probability that
    the second has the missing value, over that of its most likely one."""
    total = good + bad
    if drawn > total - drawn:
        return good - hypergeometric(rng, good, bad, total - drawn)
    if not good or not bad or not drawn:
        return drawn if not bad else 0
    if total < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, drawn))
    p, rest = good / total, total - drawn
    mode = min(rest, int((rest + 1) * p))
    while True:
        x = int(rng.binomial(drawn, p))
        if 0 <= good - x <= rest and math.log(max(rng.random(), 1e-300)) <= _log_ratio(rest, p, good - x, mode):
            return x


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows that each block sends to each shard; sums are those given."""
    assert sum(blocks) == sum(shards)
    rng, left, out = np.random.default_rng(seed), list(shards), []
    for size in blocks:
        row, others, wanted = [], sum(left), size
        for k, room in enumerate(left):
            others -= room
            x = hypergeometric(rng, room, others, wanted)
            row.append(x)
            left[k] -= x
            wanted -= x
        out.append(row)
    return out


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def _draw(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def dealt(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """rows with shard and slot: a uniform shuffle into shards of equal size."""
    spark = rows.sparkSession
    carried = [c for c in rows.columns if c not in ("shard", "slot")]
    read = rows.select(F.struct(*carried).alias("_row"), F.monotonically_increasing_id().alias("_read"))
    placed = read.withColumn("_key", _draw(seed, "_read")).sortWithinPartitions("_key").select("_row", F.monotonically_increasing_id().alias("_id"))
    placed = common.scratch_table(placed, "sharding-placed").select("_row", "_id", F.shiftright("_id", _PLACE_BITS).alias("_block"),
                                                                     F.col("_id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias("_place"))
    blocks = sorted((r["_block"], r["n"]) for r in placed.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).collect())  # one number for each input task
    sizes = shard_sizes(sum(n for _, n in blocks), shards)
    matrix = communication_matrix([n for _, n in blocks], sizes, seed)
    ends = [(b, np.cumsum(row).tolist()) for (b, _), row in zip(blocks, matrix)]
    deal = spark.createDataFrame(ends, "_of long, _ends array<long>")
    if len(ends) <= BROADCAST_ROWS:
        deal = F.broadcast(deal)
    subs = max(1, -(-sum(n for _, n in blocks) // (shards * slot_rows)))
    out = placed.join(deal, F.col("_block") == F.col("_of")).select(
        "_row", "_id", F.size(F.filter("_ends", lambda e: e <= F.col("_place"))).alias("shard"), _draw(seed + 1, "_id").alias("_key"))
    out = out.withColumn("_sub", F.pmod(_draw(seed + 2, "_id"), F.lit(subs)))
    counts = out.groupBy("shard", "_sub").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if subs * shards <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    inside = Window.partitionBy("shard", "_sub").orderBy("_key", "_id")
    return out.join(offsets, ["shard", "_sub"]).select("_row.*", "shard", (F.col("_before") + F.row_number().over(inside) - 1).cast("long").alias("slot"))


def measured(docs: DataFrame) -> DataFrame:
    """docs with size and text_crc32."""
    text = common.text_or_empty()
    return docs.select(*[c for c in docs.columns if c not in OWN], (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Whole documents written by shard, each file in the order of slots."""
    dealt(measured(docs), shards, seed).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op13_sharding(spark, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; shards of equal counts."""
    docs = measured(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "text_crc32")
    return dealt(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
