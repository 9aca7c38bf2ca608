"""Driver contract, fixture anchors, oracle agreement at sf0.001 and plan shape."""
import datetime as dt
import hashlib

import duckdb
import pytest

import __spark_entry__ as E
from strata.operators import queries as Q
from strata.sources import fixtures as fx

from conftest import SF001, SF01

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"repository_id", "old_branch", "new_branch", "oid"} <= set(df.columns)


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_fixture_anchors_sf001(spark):
    assert fx.fx_nodes(spark, SF01).count() == 15015
    assert fx.fx_commit_parents(spark, SF01).count() == 15156
    assert fx.fx_commit_parents(spark, SF01).where("pos = 1").count() == 166
    assert fx.fx_commits(spark, SF01).count() == 24818
    assert fx.fx_tree_entries(spark, SF01).count() == 1757
    c = fx.fx_commits(spark, SF01)
    pairs = spark.createDataFrame([(r, "origin/release", "origin/main") for r in range(1, 26)],
                                  "repository_id long, old_branch string, new_branch string")
    assert Q.branch_diff(c, pairs, limit=None).count() == 1755
    assert Q.branch_diff(c, pairs, limit=None, key=("oid",)).count() == 3343


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.sha256("\n".join(sorted("|".join(_norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


FAST = ["branch_diff", "commits_scan", "tags", "expand_manifest", "upsert_commits", "log_page_branch", "commit_counts",
        "message_functions", "time_functions", "reachable", "rev_list", "merge_status", "flag_equivalent",
        "file_changes", "line_multiset_changes", "ingest_stats"]


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle_sf0001(spark, duck, name):
    df = E.queries()[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows) == _digest(ocols, orows)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_shapes(spark):
    q = E.queries()
    diff = _plan(q["branch_diff_top"](spark, SF001))
    assert "LeftAnti" in diff and "WindowGroupLimit" in diff
    assert "TakeOrderedAndProject" in _plan(q["global_log_page"](spark, SF001))
    assert "WindowGroupLimit" in _plan(q["cap_per_branch"](spark, SF001))
    for name in ["branch_diff", "log_page_branch", "commit_counts", "upsert_commits", "match_oid_prefix",
                 "file_changes", "line_multiset_changes", "range_commits", "flag_equivalent"]:
        p = _plan(q[name](spark, SF001))
        for bad in ["BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"]:
            assert bad not in p, (name, bad)


def test_scan_prunes_columns(spark):
    df = E.queries()["latest_commit"](spark, SF001)
    plan = _plan(df)
    schemas = [x.split("]")[0] for x in plan.split("ReadSchema: ")[1:]]
    assert schemas and all("props" not in s and "value" not in s for s in schemas)


def test_keyset_filter_reaches_stored_index(spark):
    fx.materialize(spark, SF001)
    plan = _plan(E.queries()["keyset_page"](spark, SF001))
    pushed = [x.split("]")[0] for x in plan.split("PushedFilters: [")[1:]]
    assert any("LessThan(author_time" in p and "EqualTo(branch,origin/main)" in p for p in pushed)


def test_flagship_plan_without_broadcast(spark):
    """At scale the commit tables exceed any broadcast threshold: the branch
    diff must then be a sort-merge anti-join with top-k on both sides of the
    shuffle (WindowGroupLimit partial + final)."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = _plan(E.queries()["branch_diff_top"](spark, SF001))
    finally:
        spark.conf.set(key, before)
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    assert plan.count("WindowGroupLimit") >= 2
    assert "BroadcastExchange" not in plan
