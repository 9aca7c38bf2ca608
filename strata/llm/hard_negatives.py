"""Hard-negative mining by Fagin's threshold algorithm.

Candidates are dealt by the hash of their id into blocks of bounded size.  A
block sorts its rows once by every dimension.  For an anchor the lists are read
side by side from the end that its sign favours: downwards where its component
is positive, upwards where it is negative, not at all where it is zero.  Every
row met for the first time is scored whole, in integers (random access).  After
each stretch the threshold is the score that a row would have if it equalled
the last value read in every list; no unread row can score more.  Reading stops
once the threshold is strictly below the kth best score of every window asked
(or below the window's floor): strictly, since a row of equal score and smaller
id would still come first.

Two passes: first each anchor's positives (one window: best k of the same
label), then for each positive the best k rows of other labels whose score
lies in [floor share * positive score, positive score].  Blocks return at most
k rows a window, and a window function keeps the best k over all blocks.
Anchors are dealt into blocks as well, and each pair of blocks is one group, so
nothing is broadcast and no group grows with the input.

Rows with a null label, vector or id take no part, nor those with a null or
non-finite component.  Of several rows of one id the smallest (label, vector)
counts.  Vectors of other lengths count as ending in zeros.  An anchor without
positives, or a positive without negatives in its window, gives no row; empty
input gives none.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from strata.llm import common, vectors

#: rows of a block of candidates and of a block of anchors: memory and parallelism only
CANDIDATES, ANCHORS = 2048, 512
#: rows read from every list before the threshold is looked at first; doubled each time
STRETCH = 32


class Lists:
    """A block of candidates with its rows sorted by every dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.x = ids[by_id], labels[by_id], np.ascontiguousarray(x[by_id])
        self.order = np.argsort(self.x, axis=0, kind="stable").T.copy()  # dimension by place, ascending
        self.sorted = np.take_along_axis(self.x.T, self.order, axis=1)

    def read(self, q: np.ndarray, accept: np.ndarray, windows: list[tuple[int, int]], k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """For each window (low, high) the best k accepted rows with low <= score <= high,
        as (rows, scores), best first, ties by id; and how many rows were scored.
        Rows are places in self.ids, which ascend."""
        n = len(self.ids)
        up, down = np.flatnonzero(q < 0), np.flatnonzero(q > 0)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        seen = np.zeros(n, bool)
        used, depth, stretch = 0, 0, STRETCH
        while depth < n:
            to = min(n, depth + stretch)
            met = np.zeros(n, bool)
            met[self.order[up, depth:to]] = True
            met[self.order[down, n - to: n - depth]] = True
            if not len(up) and not len(down):  # every score is zero
                met[:], to = True, n
            met &= ~seen
            seen |= met
            new = np.flatnonzero(met)
            used += len(new)
            new = new[accept[new]]
            rows, scores = np.append(rows, new), np.append(scores, self.x[new] @ q)
            depth, stretch = to, stretch * 2
            threshold = int(q[up] @ self.sorted[up, to - 1] + q[down] @ self.sorted[down, n - to])
            if all(self._settled(scores, low, high, k, threshold) for low, high in windows):
                break
        out = []
        for low, high in windows:
            inside = np.flatnonzero((scores >= low) & (scores <= high))
            best = inside[np.lexsort((rows[inside], -scores[inside]))[:k]]
            out.append((rows[best], scores[best]))
        return out, used

    @staticmethod
    def _settled(scores: np.ndarray, low: int, high: int, k: int, threshold: int) -> bool:
        if threshold < low or low > high:
            return True
        inside = scores[(scores >= low) & (scores <= high)]
        return len(inside) >= k and threshold < np.partition(inside, len(inside) - k)[len(inside) - k]


LOWEST, HIGHEST = -(1 << 62), 1 << 62


def floor_of(positive: int, low_percent: int) -> int:
    """The smallest integer s with 100 * s >= low_percent * positive."""
    return -(-low_percent * positive // 100)


def prepared(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, v): one row an id, of those that take part."""
    rows = embeddings.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & vectors.usable(vector))
    rows = rows.select("vec_id", F.col("label").cast("bigint").alias("label"), vectors.whole(vector).alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("_r")).select("vec_id", "_r.label", "_r.v")


def _pairs(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int):
    """Both sides grouped by (anchor block, candidate block); either side is copied once for each block of the other."""
    a_blocks, c_blocks = max(1, -(-n_anchors // ANCHORS)), max(1, -(-n_rows // CANDIDATES))
    block = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = anchors.withColumn("ab", block(a_blocks, 1)).withColumn("cb", every(c_blocks)).groupBy("ab", "cb")
    own = rows.select(*(F.col(c).alias(c) for c in rows.columns))  # both sides may come from one table
    right = own.withColumn("cb", block(c_blocks, 2)).withColumn("ab", every(a_blocks)).groupBy("ab", "cb")
    return left.cogroup(right)


def positives(anchors: DataFrame, rows: DataFrame, k: int, n_anchors: int, n_rows: int, dim: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score): each anchor's best k other rows of its label."""

    def run(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(c):
            lists = Lists(c["vec_id"].to_numpy(), c["label"].to_numpy(), vectors.matrix(c["v"], dim))
            for anchor, label, q in zip(a["vec_id"].to_numpy(), a["label"].to_numpy(), vectors.matrix(a["v"], dim)):
                (found,), _ = lists.read(q, (lists.labels == label) & (lists.ids != anchor), [(LOWEST, HIGHEST)], k)
                out += [(anchor, lists.ids[r], s) for r, s in zip(*found)]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score"]).astype("int64")

    found = _pairs(anchors, rows, n_anchors, n_rows).applyInPandas(run, "anchor_id long, positive_id long, positive_score long")
    w = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def negatives(anchors: DataFrame, rows: DataFrame, found: DataFrame, k: int, low_percent: int, n_anchors: int, n_rows: int, dim: int) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    asked = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("asked"))  # k at most
    asked = anchors.join(asked, "vec_id").select("vec_id", "label", "v", F.col("asked.positive_id").alias("p"), F.col("asked.positive_score").alias("s"))

    def run(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(c):
            lists = Lists(c["vec_id"].to_numpy(), c["label"].to_numpy(), vectors.matrix(c["v"], dim))
            for anchor, label, q, ps, ss in zip(a["vec_id"].to_numpy(), a["label"].to_numpy(), vectors.matrix(a["v"], dim), a["p"], a["s"]):
                # a negative score has no window: its floor lies above it
                windows = [(floor_of(int(s), low_percent), int(s)) for s in ss]
                best, _ = lists.read(q, lists.labels != label, windows, k)
                for p, s, (at, scores) in zip(ps, ss, best):
                    out += [(anchor, p, lists.ids[r], s, x) for r, x in zip(at, scores)]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]).astype("int64")

    best = _pairs(asked, rows, n_anchors, n_rows).applyInPandas(run, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    w = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(rows: DataFrame, is_anchor, k_positives: int = 5, k_negatives: int = 5, low_percent: int = 80) -> DataFrame:
    """Hard negatives of the rows (vec_id, label, v) that meet the condition is_anchor."""
    rows = common.scratch_table(rows, "negatives-rows")
    n_rows, dim, top = vectors.shape(rows)
    vectors.within(dim, top, max(low_percent, 4))
    anchors = rows.where(is_anchor)
    n_anchors = anchors.count()
    found = common.scratch_table(positives(anchors, rows, k_positives, n_anchors, n_rows, dim), "negatives-positives")
    return negatives(anchors, rows, found, k_negatives, low_percent, n_anchors, n_rows, dim)


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, against all others."""
    rows = prepared(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", shifted), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH used AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM used a JOIN used b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM scored WHERE same) t WHERE n <= 5),
neg AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM pos p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 5
"""
