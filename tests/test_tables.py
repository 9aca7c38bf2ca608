"""Upserts, inserts and lookups on hand fixtures (K*, P*)."""
import datetime as dt

from strata.operators import queries as Q
from strata.operators import tables as T
from strata.sources import schemas

T0 = dt.datetime(2024, 1, 1)


def commit(oid, branch="origin/main", summary="s", t=0, repo=1):
    ts = T0 + dt.timedelta(minutes=t)
    return (repo, oid, branch, "u", "u@x", ts, "u", "u@x", ts, summary, "m", [], T0)


def test_insert_dedupes_batch_and_is_idempotent(spark):
    existing = spark.createDataFrame([commit("a")], schemas.COMMITS)
    batch = spark.createDataFrame([commit("a"), commit("b"), commit("b", summary="other"), commit("b", "origin/dev")],
                                  schemas.COMMITS)
    ins = T.insert_new_commits(existing, batch)
    assert sorted((r["oid"], r["branch"]) for r in ins.collect()) == [("b", "origin/dev"), ("b", "origin/main")]
    state = existing.unionByName(ins)
    assert T.insert_new_commits(state, batch).count() == 0


def test_upsert_keeps_untouched_columns(spark):
    existing = spark.createDataFrame([commit("a", summary="old"), commit("c")], schemas.COMMITS)
    inc = spark.createDataFrame([commit("a", summary="new", t=99), commit("b", summary="fresh")], schemas.COMMITS)
    got = {r["oid"]: r for r in T.upsert_commits(existing, inc).collect()}
    assert got["a"]["summary"] == "new" and got["a"]["author_time"] == T0      # time kept from the index
    assert got["b"]["summary"] == "fresh" and got["c"]["summary"] == "s"


def test_refs_symbolic_and_remote_filter(spark):
    feed = spark.createDataFrame([(1, "refs/remotes/origin/main", "a" * 40, True), (1, "refs/remotes/origin/HEAD", None, False),
                                  (1, None, "b" * 40, False), (1, "refs/remotes/upstream/x", "c" * 40, False)],
                                 schemas.REF_FEED)
    b = T.refs_to_branches(feed, "2024-01-01 00:00:00")
    assert sorted(r["name"] for r in b.collect()) == ["origin/main", "upstream/x"]
    assert [r["name"] for r in T.remote_branches(b).collect()] == ["origin/main"]
    assert sorted(r["reason"] for r in T.rejected_refs(feed).collect()) == ["no_name", "no_target"]


def test_default_branch_fallbacks(spark):
    repos = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    br = spark.createDataFrame([(1, "origin/b", False), (1, "origin/a", False), (2, "origin/z", True), (2, "origin/a", False)],
                               "repository_id long, name string, is_default boolean")
    got = {r[0]: r[1] for r in T.default_branch(repos, br).collect()}
    assert got == {1: "origin/a", 2: "origin/z", 3: "origin/main"}


def test_branch_diff_self_is_empty_and_logical_key(spark):
    rows = [commit("a", "origin/r", "x", 1), commit("b", "origin/m", "x", 1), commit("c", "origin/r", "y", 2)]
    c = spark.createDataFrame(rows, schemas.COMMITS)
    pairs = spark.createDataFrame([(1, "origin/r", "origin/m"), (1, "origin/r", "origin/r")],
                                  "repository_id long, old_branch string, new_branch string")
    got = sorted((r["new_branch"], r["oid"]) for r in Q.branch_diff(c, pairs).collect())
    assert got == [("origin/m", "c")]


def test_log_page_ties_and_flags(spark):
    rows = [commit(o, t=0) for o in ["c", "a", "b"]] + [commit("d", t=5)]
    c = spark.createDataFrame(rows, schemas.COMMITS)
    page = [r["oid"] for r in Q.log_page(c, limit=2, offset=1, per_branch=True).orderBy("page_rank").collect()]
    assert page == ["a", "b"]
    flags = Q.page_flags(c, limit=2, offset=2).first()
    assert (flags["rows"], flags["has_more"]) == (2, False)
    faithful = Q.page_flags(c, limit=2, offset=2, faithful=True).first()
    assert faithful["has_more"] is True


def test_prefix_match_two_way(spark):
    left = spark.createDataFrame([(1, "abcdef0123456789")], "repository_id long, oid string")
    right = spark.createDataFrame([(1, "abcdef0"), (1, "abcdef0123456789ffff"), (1, "abcdef1"), (1, "abc"), (2, "abcdef0")], "repository_id long, oid string")
    got = sorted(r["matched_oid"] for r in Q.match_oid_prefix(left, right).collect())
    assert got == ["abc", "abcdef0", "abcdef0123456789ffff"]


def test_commit_index_writer_roundtrip_sorted(spark, tmp_path):
    from strata.sources.sinks import INDEX_ORDER, write_commit_index
    rows = [commit(f"o{i:03d}", branch=f"origin/b{i % 3}", t=i, repo=i % 4) for i in range(60)]
    df = spark.createDataFrame(rows, schemas.COMMITS)
    path = str(tmp_path / "index")
    write_commit_index(df, path, files=3)
    back = spark.read.parquet(path)
    assert back.count() == 60 and back.exceptAll(df).count() == 0
    from pyspark.sql import functions as F
    per_file = back.withColumn("f", F.input_file_name()).groupBy("f").agg(
        F.collect_list(F.struct(*INDEX_ORDER)).alias("rows")).collect()
    for r in per_file:                     # every file is sorted on the index order
        keys = [tuple(x) for x in r["rows"]]
        assert keys == sorted(keys)


def test_a_cluster_without_a_checkpoint_folder_is_refused():
    from types import SimpleNamespace as N

    import pytest

    from strata.session import ensure_checkpoint_dir

    jsc = N(sc=lambda: N(getCheckpointDir=lambda: N(isDefined=lambda: False)))
    sc = N(_jsc=jsc, master="spark://host:7077", getConf=lambda: N(get=lambda k, d=None: d))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(N(sparkContext=sc))


def test_upsert_keeps_the_last_row_of_a_key(spark):
    from strata.operators import tables as T

    cols = "repository_id long, name string, target_oid string, is_default boolean, updated_at timestamp_ntz"
    old = spark.sql("SELECT 1L repository_id, 'x' name, 'a' target_oid, false is_default, TIMESTAMP_NTZ '2024-01-01 00:00:00' updated_at")
    inc = spark.sql("""SELECT * FROM VALUES (1L, 'x', 'b', false, TIMESTAMP_NTZ '2024-01-02 00:00:00'), (1L, 'x', 'c', false, TIMESTAMP_NTZ '2024-01-03 00:00:00'),
        (1L, 'y', 'd', false, TIMESTAMP_NTZ '2024-01-03 00:00:00'), (1L, 'y', 'e', true, TIMESTAMP_NTZ '2024-01-02 00:00:00') AS t(repository_id, name, target_oid, is_default, updated_at)""")
    assert cols and sorted((r["name"], r["target_oid"]) for r in T.upsert_branches(old, inc).collect()) == [("x", "c"), ("y", "d")]


def test_prefixes_match_within_a_repository_at_any_length(spark):
    from strata.operators import queries as Q

    left = spark.createDataFrame([(1, "abcdef0"), (2, "abcdef0"), (1, "ab")], "repository_id long, oid string")
    right = spark.createDataFrame([(1, "ABC"), (2, "b"), (1, "abcdef0123")], "repository_id long, oid string")
    got = sorted((r["repository_id"], r["oid"], r["matched_oid"]) for r in Q.match_oid_prefix(left, right).collect())
    assert got == [(1, "ab", "ABC"), (1, "ab", "abcdef0123"), (1, "abcdef0", "ABC"), (1, "abcdef0", "abcdef0123")]


def test_many_blob_folders_are_listed_by_few_tasks(spark, tmp_path):
    """A listing has as many tasks as the cores ask for, not one a folder, and the setting is put back."""
    from strata.sources import blobs as B

    for i in range(300):
        (tmp_path / "1" / "abcdef0" / f"f{i}").mkdir(parents=True)
        (tmp_path / "1" / "abcdef0" / f"f{i}" / "x.txt").write_text(f"t{i}\n")
    sc, key = spark.sparkContext, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    sc.setJobGroup("listing", "listing")
    try:
        found = B.read_blobs(spark, str(tmp_path))
        jobs = sc.statusTracker().getJobIdsForGroup("listing")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    stages = [sc.statusTracker().getStageInfo(s) for j in jobs for s in sc.statusTracker().getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages) <= 4 * sc.defaultParallelism < 300
    assert spark.conf.get(key) == before
    assert found.select("path").distinct().count() == 300 and found.where("content = 't7\n'").first()["path"] == "f7/x.txt"


def test_branch_diff_spreads_one_branch_over_tasks(spark):
    """Where the pairs are not broadcast, a branch's commits do not all meet them in one task."""
    from pyspark.sql import functions as F

    rows = [(1, f"o{i}", b, i, f"s{i % 50}") for b in ("a", "main") for i in range(400) if b == "a" or i % 3]
    commits = spark.createDataFrame(rows, "repository_id long, oid string, branch string, author_time long, summary string").withColumn("committer_time", F.col("author_time"))
    pairs = spark.createDataFrame([(1, "a", "main")], "repository_id long, old_branch string, new_branch string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = Q.branch_diff(commits, pairs)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.split("hashpartitioning(")[1:] if "branch" in x.split("),")[0] and "_salt" not in x.split("),")[0] and "author_time" not in x.split("),")[0]]
        assert "_salt" not in got.columns and sorted(r["oid"] for r in got.collect()) == sorted(f"o{i}" for i in range(0, 400, 3))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
