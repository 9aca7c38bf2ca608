"""Registered queries: streaming ingest (ST1-ST5) and ingest statistics (A2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions import scalars as S
from strata.operators import graph as G
from strata.operators import tables as T
from strata.plans.catalog import register
from strata.plans.q_graph import SPLIT, WALK_SQL, graph_frontier
from strata.session import scratch_path
from strata.sources import fixtures as fx
from strata.sources import schemas
from strata.streaming import ingest as ST

CREATED = "2024-02-01 00:00:00"
_MEMO: dict = {}


def _feed_drops(spark, d):
    """Per-branch feed rows dropped once per committer day, every row dropped
    again the next day (overlap), plus malformed copies (39-character oids)
    of rows whose oid starts with '00'."""
    c = fx.fx_commits(spark, d)
    feed = c.select("repository_id", "oid", "author_name", "author_email", S.ts_to_epoch("author_time").alias("author_time"),
                    "committer_name", "committer_email", S.ts_to_epoch("committer_time").alias("committer_time"),
                    "summary", "message", "parent_oids", "branch",
                    F.datediff(F.to_date("committer_time"), F.lit("2024-01-01")).alias("day"))
    again = feed.withColumn("day", F.col("day") + 1)
    bad = feed.where(F.col("oid").startswith("00")).withColumn("oid", F.substring("oid", 1, 39))
    return feed.unionByName(again).unionByName(bad)


def run_stream_ingest(spark, d):
    """Stage the drops, run the ingest stream to completion (availableNow),
    return (index_dir, runs_dir, quarantine_dir).  Once per session and input."""
    key = (spark.sparkContext.applicationId, d, fx.input_state(spark, d))
    if key in _MEMO:
        return _MEMO[key]
    base = scratch_path(spark, "stream-ingest")
    feed_dir, index_dir = f"{base}/feed", f"{base}/index"
    runs_dir, quarantine_dir, ckpt = f"{base}/runs", f"{base}/quarantine", f"{base}/checkpoint"
    ST.stage_drops(_feed_drops(spark, d), feed_dir, "day")
    q = ST.start_ingest(spark, feed_dir, index_dir, runs_dir, quarantine_dir, ckpt,
                        F.lit(CREATED).cast("timestamp_ntz"), files_per_trigger=16)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    _MEMO[key] = (index_dir, runs_dir, quarantine_dir)
    return _MEMO[key]


@register("stream_ingest", oracle="""
SELECT repository_id, oid, branch, author_time, committer_time, summary, message, parents, created_at FROM fx_commits""")
def stream_ingest(spark, d):
    """ST1/ST2/ST3: the index built by the file-source stream equals the batch index."""
    index_dir, _, _ = run_stream_ingest(spark, d)
    idx = spark.read.schema(schemas.COMMITS).parquet(index_dir)
    return idx.select("repository_id", "oid", "branch", "author_time", "committer_time", "summary", "message",
                      S.parents_to_text("parent_oids").alias("parents"), "created_at")


@register("stream_ingest_stats", oracle="""
SELECT repository_id, count(*) AS candidates, count(*) AS inserted,
       (SELECT count(*) FROM fx_commits b WHERE b.repository_id = c.repository_id AND starts_with(b.oid, '00')) AS quarantined
FROM fx_commits c GROUP BY repository_id""")
def stream_ingest_stats(spark, d):
    """A2/ST5 over the stream's run rows: candidates after de-duplication,
    inserted, and malformed rows quarantined without stopping the batch."""
    _, runs_dir, _ = run_stream_ingest(spark, d)
    runs = spark.read.parquet(runs_dir)
    return runs.groupBy("repository_id").agg(
        F.sum(F.when(F.col("status") == "ok", F.col("candidates")).otherwise(0)).cast("bigint").alias("candidates"),
        F.sum("inserted").cast("bigint").alias("inserted"),
        F.sum(F.when(F.col("status") == "failed", F.col("candidates")).otherwise(0)).cast("bigint").alias("quarantined"))


@register("ingest_stats", oracle=WALK_SQL + f""",
cand AS (SELECT repository_id, ref, count(*) AS candidates FROM walk
         WHERE n_parents <= 1 GROUP BY repository_id, ref),
ins AS (SELECT w.repository_id, w.ref, count(*) AS inserted FROM walk w
        WHERE w.n_parents <= 1
          AND NOT EXISTS (SELECT 1 FROM fx_commits c WHERE c.repository_id = w.repository_id AND c.branch = w.ref
                          AND c.oid = w.oid AND c.committer_time < TIMESTAMP '{SPLIT}')
        GROUP BY w.repository_id, w.ref),
status AS (
  SELECT r.repository_id,
         CASE WHEN r.ref_name IS NULL OR r.target_oid IS NULL THEN 'failed'
              WHEN starts_with(regexp_replace(r.ref_name, '^refs/remotes/', ''), 'origin/') THEN 'ok' ELSE 'skipped' END AS status,
         coalesce(c.candidates, 0) AS candidates, coalesce(i.inserted, 0) AS inserted
  FROM fx_raw_refs r
  LEFT JOIN cand c ON c.repository_id = r.repository_id AND c.ref = regexp_replace(r.ref_name, '^refs/remotes/', '')
                  AND r.target_oid IS NOT NULL
  LEFT JOIN ins i ON i.repository_id = r.repository_id AND i.ref = regexp_replace(r.ref_name, '^refs/remotes/', '')
                 AND r.target_oid IS NOT NULL)
SELECT 'cycle-1' AS run_id, repository_id, CAST(sum(candidates) AS BIGINT) AS candidates, CAST(sum(inserted) AS BIGINT) AS inserted,
       count(*) FILTER (WHERE status = 'ok') AS branches_indexed, count(*) FILTER (WHERE status = 'failed') AS branches_failed,
       count(*) FILTER (WHERE status = 'skipped') AS branches_skipped
FROM status GROUP BY repository_id""")
def ingest_stats(spark, d):
    """A2: one index cycle per repository: candidates (walked, before the
    conflict skip), inserted, branches indexed / failed / skipped."""
    g, front = graph_frontier(spark, d)
    raw = fx.fx_raw_refs(spark, d)
    branches = T.refs_to_branches(raw, CREATED)
    index = fx.fx_commits(spark, d).where(F.col("committer_time") < F.lit(SPLIT).cast("timestamp_ntz"))
    walk, ins = G.walk(g, front), G.walk(g, front, indexed=index)
    cand = walk.groupBy("repository_id", "ref").agg(F.count(F.lit(1)).alias("candidates"))
    done = ins.groupBy("repository_id", "ref").agg(F.count(F.lit(1)).alias("inserted"))
    ok = (branches.select("repository_id", F.col("name").alias("ref"))
          .withColumn("status", F.when(F.col("ref").startswith(S.ORIGIN_PREFIX), "ok").otherwise("skipped"))
          .join(cand, ["repository_id", "ref"], "left").join(done, ["repository_id", "ref"], "left"))
    failed = T.rejected_refs(raw).select("repository_id", F.col("ref_name").alias("ref"), F.lit("failed").alias("status"),
                                         F.lit(None).cast("bigint").alias("candidates"), F.lit(None).cast("bigint").alias("inserted"))
    rows = ok.unionByName(failed)
    return rows.groupBy("repository_id").agg(
        F.sum(F.coalesce("candidates", F.lit(0))).cast("bigint").alias("candidates"),
        F.sum(F.coalesce("inserted", F.lit(0))).cast("bigint").alias("inserted"),
        F.count_if(F.col("status") == "ok").alias("branches_indexed"),
        F.count_if(F.col("status") == "failed").alias("branches_failed"),
        F.count_if(F.col("status") == "skipped").alias("branches_skipped"),
    ).select(F.lit("cycle-1").alias("run_id"), "*")
