"""What keeps the history queries in proportion to their input: how often the events
are read and shuffled, one tree a commit, and few ranking rounds."""

import pytest
from pyspark.sql import functions as F

from strata.operators import graph as G
from strata.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def late_trunk(spark, tmp_path):
    """Events twice, the second time with ids after all others: trunk events come after lane events."""
    e = spark.read.parquet(f"{SF}/events.parquet")
    n = e.agg(F.max("event_id")).first()[0] + 1
    e.unionByName(e.withColumn("event_id", F.col("event_id") + n)).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_history_shuffles_the_events_once(spark):
    plan = fx.fx_history(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 2  # bucket summaries, and the events


def test_a_commit_has_one_tree_whatever_the_order_of_ids(spark, late_trunk, monkeypatch):
    got = []
    for bucket in (7, 1 << 16):
        monkeypatch.setattr(fx, "BUCKET", bucket)
        listed, commits = fx.fx_tree_history(spark, late_trunk)
        got.append((sorted(map(tuple, commits.collect())), sorted((r[0], *r[1]) for r in listed.collect())))
    assert got[0] == got[1]
    assert len({c[:2] for c in got[0][0]}) == len(got[0][0]) == fx.fx_nodes(spark, late_trunk).count()
    assert len({t[0] for t in got[0][1]}) == len(got[0][1])


def test_parents_do_not_depend_on_the_bucket(spark, late_trunk, monkeypatch):
    got = []
    for bucket in (7, 1 << 16):
        monkeypatch.setattr(fx, "BUCKET", bucket)
        got.append(sorted(map(str, fx.fx_history(spark, late_trunk).collect())))
    assert got[0] == got[1]


def test_ranking_runs_over_the_entries_of_batches(spark):
    n = 3000
    nodes = spark.range(n).select(F.lit(1).cast("bigint").alias("repository_id"), F.col("id").cast("string").alias("oid"),
                                  F.timestamp_seconds("id").alias("committer_time"))
    edges = spark.range(1, n).select(F.lit(1).cast("bigint").alias("repository_id"), F.col("id").cast("string").alias("oid"), F.lit(0).alias("pos"),
                                     (F.col("id") - 1).cast("string").alias("parent_oid"))
    g = G.CommitGraph(nodes, edges)
    place = g.index().join(g.ids(), "nid").select(F.col("oid").cast("int"), "chain", "cpos").orderBy("oid").collect()
    assert [r["cpos"] for r in place] == list(range(n)) and len({r["chain"] for r in place}) == 1
    assert g.rounds["ranking"] <= 5  # 12 by pointer jumping over all nodes


def test_late_commits_do_not_cost_a_frontier_round_each(spark):
    """Every fifth commit of a line of 400 comes after its child: the stored chains are put end to end."""
    from strata.operators import graph_store as GS
    n = 400
    late = lambda k: k % 5 == 0 and k > 0
    old, new = [k for k in range(n) if not late(k)], [k for k in range(n) if late(k)]
    frame = lambda rows, cols: spark.createDataFrame(rows, cols)
    chain, coords = 0, []
    for k in old:
        chain = chain if k and not late(k - 1) else k
        coords.append((k, chain, k - chain))
    for k in new:  # ends the chain of its parent
        c = next(c for a, c, _ in coords if a == k - 1)
        coords.append((k, c, k - c))
    by = {a: (c, p) for a, c, p in coords}
    cross = [(*by[k], *by[k - 1]) for k in range(1, n) if by[k][0] != by[k - 1][0]]
    conts = [(k - 1, k) for k in range(1, n) if by[k][0] == by[k - 1][0]]
    index, edges, follow = GS.joined(frame(coords, "nid long, chain long, cpos long"), frame(cross, "src_chain long, src_pos long, dst_chain long, dst_pos long"),
                                     frame(conts, "pid long, child long"))
    assert len(cross) > 70 and edges.isEmpty()
    assert sorted((r["nid"], r["chain"], r["cpos"]) for r in index.collect()) == [(k, 0, k) for k in range(n)]
    assert sorted(map(tuple, follow.collect())) == [(k - 1, k) for k in range(1, n)]


def test_forced_moves_reads_old_tips_not_all_commits(spark):
    """The old tips' coordinates are looked up step by step; the result no longer reads the commits."""
    from strata.operators import graph as G
    from strata.operators import graph_store as GS
    oid = lambda k: f"{k:040d}"
    parents = {k: [k - 1] for k in range(1, 40)} | {100: [20], 101: [100], 39: [38, 101]}
    nodes = spark.createDataFrame([(1, oid(k)) for k in [0, *parents]], "repository_id long, oid string")
    edges = spark.createDataFrame([(1, oid(k), i, oid(p)) for k, ps in parents.items() for i, p in enumerate(ps)], "repository_id long, oid string, pos int, parent_oid string")
    want = {(10, 30): False, (30, 10): True, (101, 39): False, (101, 38): True, (20, 101): False, (21, 101): True, (77, 5): None, (None, 5): None}
    moves = spark.createDataFrame([(1, "b", None if a is None else oid(a), oid(b)) for a, b in want], "repository_id long, name string, old_oid string, target_oid string")
    graph = G.CommitGraph(nodes, edges)
    out = GS.forced_moves(graph, moves)
    assert {(None if r["old_oid"] is None else int(r["old_oid"]), int(r["target_oid"])): r["forced"] for r in out.collect()} == want
    assert not set(graph.ids().inputFiles()) & set(out.inputFiles())
