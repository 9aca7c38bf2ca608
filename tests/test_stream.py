"""Streaming ingest equals the batch index; replay inserts nothing twice."""
import tempfile

import pytest

from pyspark.sql import functions as F

from strata.plans import q_stream
from strata.sources import fixtures as fx
from strata.sources import schemas
from strata.streaming import ingest as ST

from conftest import SF001


def test_stream_equals_batch_and_replay(spark):
    base = tempfile.mkdtemp(prefix="strata-stream-", dir="/tmp")
    feed_dir, index_dir = f"{base}/feed", f"{base}/index"
    ST.stage_drops(q_stream._feed_drops(spark, SF001), feed_dir, "day")
    created = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    q = ST.start_ingest(spark, feed_dir, index_dir, f"{base}/runs", f"{base}/quar", f"{base}/ck", created, files_per_trigger=8)
    q.awaitTermination()
    assert q.exception() is None
    idx = spark.read.schema(schemas.COMMITS).parquet(index_dir)
    batch = fx.fx_commits(spark, SF001)
    key = ["repository_id", "oid", "branch"]
    assert idx.count() == batch.count()
    assert idx.select(*key).exceptAll(batch.select(*key)).count() == 0
    quarantined = spark.read.parquet(f"{base}/quar")
    assert quarantined.count() > 0 and quarantined.where(F.length("oid") != 39).count() == 0
    # replay every file in a new stream (fresh checkpoint): the anti-join inserts nothing
    q2 = ST.start_ingest(spark, feed_dir, index_dir, f"{base}/runs2", f"{base}/quar2", f"{base}/ck2", created)
    q2.awaitTermination()
    assert spark.read.schema(schemas.COMMITS).parquet(index_dir).count() == batch.count()
    runs2 = spark.read.parquet(f"{base}/runs2")
    assert runs2.agg(F.sum("inserted")).first()[0] == 0


def test_replay_of_a_batch_leaves_the_same_rows_and_late_is_counted(spark):
    base = tempfile.mkdtemp(prefix="strata-stream-replay-", dir="/tmp")
    dirs = [f"{base}/index", f"{base}/runs", f"{base}/quar"]
    created = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    rows = q_stream._feed_drops(spark, SF001).drop("day").where("repository_id <= 2").dropDuplicates(ST.KEY)
    old, new = rows.where("committer_time % 2 = 0"), rows.where("committer_time % 2 = 1")
    state = []
    for batch, name in ((old, 0), (new, 1), (new, 1), (old, 0)):
        ST.process_batch(batch, name, *dirs, created)
        runs = spark.read.parquet(dirs[1])
        state.append((spark.read.schema(schemas.COMMITS).parquet(dirs[0]).count(), runs.where("status = 'ok'").agg(F.sum("inserted")).first()[0],
                      runs.where("status = 'failed'").agg(F.sum("candidates")).first()[0] or 0, spark.read.parquet(dirs[2]).count(), runs.agg(F.sum("late")).first()[0]))
    assert state[1] == state[2] and state[1][0] == state[1][1] and state[1][2] == state[1][3]
    assert state[3][:4] == state[1][:4]
    # late: inserted by batch 1 though its branch held a newer commit already
    good = "length(oid) = 40 and size(parent_oids) <= 1"
    newest = old.where(good).groupBy("repository_id", "branch").agg(F.max("committer_time").alias("top"))
    assert state[1][4] == new.where(good).join(newest, ["repository_id", "branch"]).where("committer_time < top").count()


def test_an_unreadable_index_is_not_an_empty_one(spark):
    base = tempfile.mkdtemp(prefix="strata-stream-bad-", dir="/tmp")
    with open(f"{base}/part-0.parquet", "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):
        ST._index_without(spark, base, "x").count()
    assert ST._index_without(spark, f"{base}/none", "x").count() == 0


def test_timer_trigger_ingests_everything(spark):
    """ST1: the same stream on a processing-time trigger (the polling timer)."""
    base = tempfile.mkdtemp(prefix="strata-stream-timer-", dir="/tmp")
    feed_dir, index_dir = f"{base}/feed", f"{base}/index"
    ST.stage_drops(q_stream._feed_drops(spark, SF001), feed_dir, "day")
    created = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    q = ST.start_ingest(spark, feed_dir, index_dir, f"{base}/runs", f"{base}/quar", f"{base}/ck", created,
                        trigger={"processingTime": "1 second"}, files_per_trigger=16, state_partitions=4)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    idx = spark.read.schema(schemas.COMMITS).parquet(index_dir)
    assert idx.count() == fx.fx_commits(spark, SF001).count()


def test_state_partitions_leave_caller_setting(spark):
    base = tempfile.mkdtemp(prefix="strata-stream-conf-", dir="/tmp")
    ST.stage_drops(q_stream._feed_drops(spark, SF001).limit(50), f"{base}/feed", "day")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    q = ST.start_ingest(spark, f"{base}/feed", f"{base}/index", f"{base}/runs", f"{base}/quar", f"{base}/ck",
                        F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"), state_partitions=3)
    q.awaitTermination()
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bound", [100_000, 0])
def test_only_keys_that_may_be_stored_are_compared(spark, monkeypatch, bound):
    monkeypatch.setattr(ST, "MAX_SUSPECTS", bound)
    rows = fx.fx_commits(spark, SF001).where("repository_id <= 3").localCheckpoint()
    stored = rows.where("crc32(oid) % 3 = 0").localCheckpoint()
    twice = rows.unionByName(rows.where("crc32(oid) % 5 = 0").withColumn("summary", F.lit("later"))).localCheckpoint()
    new = ST._new_rows(stored, twice)
    want = q_stream.T.insert_new_commits(stored, twice)
    assert new.columns == want.columns and want.count() > 0
    assert new.exceptAll(want).isEmpty() and want.exceptAll(new).isEmpty()
    fresh = rows.where("crc32(oid) % 3 <> 0").localCheckpoint()
    assert "Exchange" not in _plan(ST._new_rows(stored, fresh)) and ST._new_rows(stored, rows.limit(0)).isEmpty()


def test_state_lies_on_disk_and_is_sized_by_a_batch(spark, monkeypatch):
    base = tempfile.mkdtemp(prefix="strata-stream-state-", dir="/tmp")
    ST.stage_drops(q_stream._feed_drops(spark, SF001).limit(200), f"{base}/feed", "day")
    monkeypatch.setattr(ST, "PARTITION_BYTES", ST._batch_bytes(spark, f"{base}/feed", 1000) // (spark.sparkContext.defaultParallelism + 3))
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    q = ST.start_ingest(spark, f"{base}/feed", f"{base}/index", f"{base}/runs", f"{base}/quar", f"{base}/ck", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    q.awaitTermination()
    assert q.exception() is None and spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == provider
    state = q.recentProgress[0]["stateOperators"][0]
    assert state["numShufflePartitions"] > spark.sparkContext.defaultParallelism
    assert any(k.startswith("rocksdb") for k in state["customMetrics"])
    assert ST._batch_bytes(spark, f"{base}/none", 1) == 0
