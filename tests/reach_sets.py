"""Set forms of the range operators, over materialised reachable sets: the tests hold the frontier forms against them."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.graph import R, _is_merge


def range_commits(reach: DataFrame, pairs: DataFrame, attrs: DataFrame, limit: int | None = None) -> DataFrame:
    """``old..new`` per pair(repository_id, old_ref, new_ref): reachable
    from new and not from old (``reach`` = G1 output for the refs involved),
    merges dropped, then the newest ``limit`` per pair."""
    new = reach.withColumnRenamed("ref", "new_ref").join(pairs, [R, "new_ref"])
    old = reach.withColumnRenamed("ref", "old_ref")
    diff = new.join(old, [R, "old_ref", "oid"], "left_anti")
    diff = diff.join(_is_merge(attrs), [R, "oid"]).where(~F.col("is_merge")).drop("is_merge")
    if limit is None:
        return diff
    w = Window.partitionBy(R, "old_ref", "new_ref").orderBy(F.col("committer_time").desc(), F.col("oid"))
    return diff.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")


def common_history(reach: DataFrame, pairs: DataFrame) -> DataFrame:
    """Commits reachable from both refs of each pair(repository_id, a_ref, b_ref)."""
    a = reach.withColumnRenamed("ref", "a_ref").join(pairs, [R, "a_ref"])
    b = reach.withColumnRenamed("ref", "b_ref")
    return a.join(b, [R, "b_ref", "oid"], "left_semi")


def merge_status(reach: DataFrame, pairs: DataFrame) -> DataFrame:
    """Merging ``source_ref`` into ``target_ref``: behind = commits only
    the source has, ahead = commits only the target has;
    up_to_date (behind 0), fast_forward (ahead 0), else diverged."""
    t = reach.withColumnRenamed("ref", "target_ref")
    s = reach.withColumnRenamed("ref", "source_ref")
    ahead = (t.join(pairs, [R, "target_ref"]).join(s, [R, "source_ref", "oid"], "left_anti")
             .groupBy(R, "target_ref", "source_ref").agg(F.count(F.lit(1)).alias("ahead")))
    behind = (s.join(pairs, [R, "source_ref"]).join(t, [R, "target_ref", "oid"], "left_anti")
              .groupBy(R, "target_ref", "source_ref").agg(F.count(F.lit(1)).alias("behind")))
    k = [R, "target_ref", "source_ref"]
    out = pairs.select(*k).join(ahead, k, "left").join(behind, k, "left")
    a = F.coalesce("ahead", F.lit(0)).cast("bigint")
    b = F.coalesce("behind", F.lit(0)).cast("bigint")
    status = F.when(b == 0, F.lit("up_to_date")).when(a == 0, F.lit("fast_forward")).otherwise(F.lit("diverged"))
    return out.select(*k, a.alias("ahead"), b.alias("behind"), status.alias("status"))
