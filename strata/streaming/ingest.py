"""Structured Streaming ingest of exported commit feeds (ST1-ST5).

The original tool polls every repository on a timer and indexes what is new.
Here the exporter drops feed files (one row per commit and branch walked)
into a folder; a file-source stream picks them up and each micro-batch runs
the batch operators in ``foreachBatch``:

* P6/F10 quarantine of malformed rows (ST5, the batch goes on),
* P5 merge filter and P10 conversion,
* K1 insert against the current index (anti-join on the key),
* per-branch run rows for A2 (candidates, inserted, late).

Index, run rows and quarantine are written to a folder of their own for each
batch of each stream and overwritten by a replay, which compares itself with
the other batches only: a batch that ran twice leaves what it left the first
time.

``trigger(availableNow=True)`` is the on-demand sync (ST2); a
``processingTime`` trigger is the timer (ST1).  Stream-side duplicates are
dropped within a watermark on *arrival* time (ST3), which bounds state; a
watermark on committer time would discard exactly the late commits (ST4) the
index must keep.  The index is partitioned by ``repository_id`` so the
anti-join reads only the touched repositories (partition pruning).

The stream's session has no adaptive execution, so its state partitions are
sized here by the bytes of a batch.  The keys of the de-duplication lie in
RocksDB, not in an executor's heap, and a batch is shuffled again only if some
of its keys may not be new.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions import scalars as S
from strata.operators import tables as TB
from strata.sources import schemas

FEED_DROP = T.StructType(schemas.COMMIT_FEED.fields + [T.StructField("branch", T.StringType())])
KEY = ["repository_id", "oid", "branch"]
#: feed bytes (compressed) for each state partition of a batch
PARTITION_BYTES = 32 << 20
#: key hashes that are broadcast; with more, a batch is compared with the index as a whole
MAX_SUSPECTS = 100_000
#: repositories of a batch that are named to prune the index; with more it is read whole
MAX_NAMED = 1000
#: days, or other drops, that a task writes side by side without sorting its rows
OPEN_FILES = 32
CODEC = "zstd"


def _index_without(spark: SparkSession, index_dir: str, batch: str) -> DataFrame:
    """The index as the other batches left it."""
    try:
        index = spark.read.schema(T.StructType(schemas.COMMITS.fields + [T.StructField("batch", T.StringType())])).parquet(index_dir)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.COMMITS)  # the first batch
    return index.where(F.col("batch") != batch).select(*schemas.COMMITS.names)


def _new_rows(current: DataFrame, rows: DataFrame) -> DataFrame:
    """K1: the rows of ``insert_new_commits``.  A key whose hash occurs once in the batch and the index
    together is new; only the rows of other hashes are shuffled and compared by the key itself."""
    key = F.xxhash64(*KEY)
    hashes = rows.select(key.alias("_h")).unionByName(current.select(key.alias("_h")))
    few = [r["_h"] for r in hashes.groupBy("_h").count().where("count > 1").select("_h").limit(MAX_SUSPECTS + 1).collect()]
    if not few:
        return rows
    if len(few) > MAX_SUSPECTS:
        return TB.insert_new_commits(current, rows)
    suspects = F.broadcast(rows.sparkSession.createDataFrame([(h,) for h in few], "_h bigint"))

    def having(df: DataFrame, how: str) -> DataFrame:
        return df.withColumn("_h", key).join(suspects, "_h", how).drop("_h")

    return having(rows, "left_anti").unionByName(TB.insert_new_commits(having(current, "left_semi"), having(rows, "left_semi")))


def process_batch(batch: DataFrame, batch_id: int, index_dir: str, runs_dir: str, quarantine_dir: str,
                  created_at, stream: str = "stream") -> None:
    """One micro-batch: quarantine, convert, insert new keys, record run rows.

    The batch's inserts are written to ``<index>/batch=<stream>-<id>``
    (overwritten on replay) and read back from there, so the anti-join runs
    once and the statistics read only this batch's rows."""
    batch = batch.persist()     # used four times; the stateful dedupe runs once
    try:
        _process(batch, f"{stream}-{batch_id}", index_dir, runs_dir, quarantine_dir, created_at)
    finally:
        batch.unpersist()


def _process(batch: DataFrame, name: str, index_dir: str, runs_dir: str, quarantine_dir: str, created_at) -> None:
    spark = batch.sparkSession
    own = f"batch={name}"
    ok = S.is_valid_oid("oid") & F.col("branch").isNotNull() & F.col("repository_id").isNotNull()
    bad = batch.where(~ok)
    good = batch.where(ok)
    bad.write.mode("overwrite").parquet(f"{quarantine_dir.rstrip('/')}/{own}")

    rows = TB.feed_to_commits(TB.drop_merges(good), created_at)
    touched = [r["repository_id"] for r in rows.select("repository_id").distinct().limit(MAX_NAMED + 1).collect()]
    current = _index_without(spark, index_dir, name)
    if len(touched) <= MAX_NAMED:
        current = current.where(F.col("repository_id").isin(*touched))
    path = f"{index_dir.rstrip('/')}/{own}"
    # outside of a stream rebalanced at run time: a hot repository is split by its size, small ones share a task
    fresh = _new_rows(current, rows).hint("rebalance", "repository_id")
    fresh.write.mode("overwrite").partitionBy("repository_id").parquet(path, compression=CODEC)
    staged = spark.read.schema(schemas.COMMITS).parquet(path)

    # run rows (A2 input): candidates before the conflict skip, inserted after,
    # late = inserted but older than the branch's newest commit before this batch
    newest = current.groupBy("repository_id", "branch").agg(F.max("committer_time").alias("prev_max"))
    cand = rows.groupBy("repository_id", "branch").agg(F.count(F.lit(1)).alias("candidates"))
    ins = (staged.join(newest, ["repository_id", "branch"], "left")
           .groupBy("repository_id", "branch")
           .agg(F.count(F.lit(1)).alias("inserted"),
                F.count_if(F.col("committer_time") < F.col("prev_max")).alias("late")))
    run_id = F.lit(name)
    runs = cand.join(ins, ["repository_id", "branch"], "left").select(
        run_id.alias("run_id"), "repository_id", "branch", F.lit("ok").alias("status"),
        "candidates", F.coalesce("inserted", F.lit(0)).cast("bigint").alias("inserted"),
        F.coalesce("late", F.lit(0)).cast("bigint").alias("late"))
    failed = bad.groupBy("repository_id", "branch").agg(F.count(F.lit(1)).alias("candidates")).select(
        run_id.alias("run_id"), "repository_id", "branch", F.lit("failed").alias("status"),
        "candidates", F.lit(0).cast("bigint").alias("inserted"), F.lit(0).cast("bigint").alias("late"))
    runs.unionByName(failed).write.mode("overwrite").parquet(f"{runs_dir.rstrip('/')}/{own}")


def start_ingest(spark: SparkSession, feed_dir: str, index_dir: str, runs_dir: str, quarantine_dir: str,
                 checkpoint_dir: str, created_at, trigger: dict | None = None, files_per_trigger: int | None = None,
                 dedupe_window: str = "1 hour", state_partitions: int | None = None):
    """Start the ingest stream; returns the StreamingQuery.

    ``trigger`` is passed to ``writeStream.trigger`` (default availableNow).
    ``state_partitions`` sizes the de-duplication state (and the shuffles of
    each micro-batch); it defaults to the cluster's total cores, or more if a
    batch of the feed as it is has more than PARTITION_BYTES for each.  It is fixed
    in the checkpoint at the first start; the stream runs on a clone of the
    session, so the caller's settings are restored right after ``start()``."""
    reader = spark.readStream.schema(FEED_DROP)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = (reader.parquet(feed_dir)
              .withColumn("_arrived", F.col("_metadata.file_modification_time"))
              .withWatermark("_arrived", dedupe_window)
              .dropDuplicatesWithinWatermark(KEY)
              .drop("_arrived"))

    # a stream is its checkpoint: batch numbers of another one are other batches
    stream_name = hashlib.sha1(checkpoint_dir.encode()).hexdigest()[:12]

    def run(batch, batch_id):
        process_batch(batch, batch_id, index_dir, runs_dir, quarantine_dir, created_at, stream_name)

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(**(trigger or {"availableNow": True}))
    provider = "spark.sql.streaming.stateStore."
    partitions = state_partitions or max(spark.sparkContext.defaultParallelism, -(-_batch_bytes(spark, feed_dir, files_per_trigger) // PARTITION_BYTES))
    settings = {"spark.sql.shuffle.partitions": str(partitions),
                provider + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
                provider + "rocksdb.boundedMemoryUsage": "true"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return w.start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _batch_bytes(spark: SparkSession, feed_dir: str, files_per_trigger: int | None) -> int:
    """Bytes of the largest batch that the feed as it is gives; 0 without a feed."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(feed_dir)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0
    found = fs.getContentSummary(path)
    files, size = max(found.getFileCount(), 1), found.getLength()
    return size * min(files_per_trigger or files, files) // files


def stage_drops(feed: DataFrame, feed_dir: str, drop_col: str) -> None:
    """Write a feed as one folder per value of ``drop_col`` (one job), the way
    an exporter drops files; the stream reads the folder tree.  Range
    partitioning on the drop keeps each drop in few files, which a task writes
    side by side, so that it need not sort its rows."""
    spark, key = feed.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(OPEN_FILES))
    try:
        feed.repartitionByRange(drop_col).write.mode("overwrite").partitionBy(drop_col).parquet(feed_dir, compression=CODEC)
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
