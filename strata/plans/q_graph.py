"""Registered queries over the commit graph (G1, G2, J2/U2, J3, J4, J5, J9,
U3, A4, A5, W3).  The oracle uses DuckDB's recursive CTE ``reach`` over the
whole fixture; Spark uses the chain index of ``strata.operators.graph``."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import diff as D
from strata.operators import graph as G
from strata.operators import queries as Q
from strata.operators import trees as TR
from strata.plans.catalog import register
from strata.session import drop_path, scratch_path
from strata.sources import fixtures as fx

SPLIT = "2024-01-25 00:00:00"
TOP = 25                # a limit that binds on the fixture, for the variants that take one
_MEMO: dict = {}


def graph_frontier(spark, d):
    """Chain index of the fixture history and the frontier of all branches,
    built once per session and state of the input files."""
    key = (spark.sparkContext.applicationId, d, fx.input_state(spark, d))
    if key not in _MEMO:
        h = fx.fx_history(spark, d)
        g = G.CommitGraph(h.select("repository_id", "oid", "committer_time", (F.size("parent_oids") > 1).alias("is_merge")), fx.fx_commit_parents(spark, d))
        refs = fx.fx_branches(spark, d).select("repository_id", F.col("name").alias("ref"), "target_oid")
        _MEMO[key] = (g, g.frontier(refs))
    return _MEMO[key]


def graph_and_reach(spark, d):
    """The chain index and the reachable set of every branch, enumerated from
    the frontier where a query asks for it; never stored."""
    g, front = graph_frontier(spark, d)
    return g, g.nodes_in(front.select("repository_id", "ref", "chain", F.lit(-1).alias("lo"), F.col("max_pos").alias("hi")),
                         ["repository_id", "ref"])


def history_changes(spark, d):
    """J7 of every commit of the tree history against its first parent: (repository_id,
    commit_oid, path, old_blob, new_blob, status); once per session and state of the input files."""
    key = (spark.sparkContext.applicationId, d, fx.input_state(spark, d), "changes")
    if key not in _MEMO:
        states = scratch_path(spark, "tree-states")
        trees, commit_trees = fx.fx_tree_history(spark, d, states)
        pairs = D.first_parent_pairs(fx.fx_history(spark, d)).withColumn("pair_id", F.struct("repository_id", F.col("to_oid").alias("commit_oid")))
        found = TR.tree_changes(trees, commit_trees, pairs, read=lambda: drop_path(spark, states))
        _MEMO[key] = found.select("pair_id.repository_id", "pair_id.commit_oid", "path", "old_blob", "new_blob", "status")
    return _MEMO[key]


def _attrs(spark, d):
    return fx.fx_history(spark, d).select("repository_id", "oid", "committer_time", "parent_oids")


def _pairs(spark, d, old="old_ref", new="new_ref"):
    p = Q.default_branch_pairs(fx.fx_repositories(spark, d), fx.fx_branches(spark, d))
    return p.select("repository_id", F.col("new_branch").alias(old), F.col("old_branch").alias(new))


WALK_SQL = """,
walk AS (
  SELECT r.repository_id, r.ref, r.oid, h.committer_time, h.n_parents,
         row_number() OVER (PARTITION BY r.repository_id, r.ref ORDER BY h.committer_time DESC, r.oid) AS walk_rank
  FROM reach r JOIN fx_history h ON h.repository_id = r.repository_id AND h.oid = r.oid)"""

PAIRS_SQL = """,
gpairs AS (SELECT repository_id, new_branch AS old_ref, old_branch AS new_ref FROM fx_pairs),
only_new AS (
  SELECT p.repository_id, p.old_ref, p.new_ref, r.oid FROM gpairs p
  JOIN reach r ON r.repository_id = p.repository_id AND r.ref = p.new_ref
  WHERE NOT EXISTS (SELECT 1 FROM reach x WHERE x.repository_id = p.repository_id AND x.ref = p.old_ref AND x.oid = r.oid)),
only_old AS (
  SELECT p.repository_id, p.old_ref, p.new_ref, r.oid FROM gpairs p
  JOIN reach r ON r.repository_id = p.repository_id AND r.ref = p.old_ref
  WHERE NOT EXISTS (SELECT 1 FROM reach x WHERE x.repository_id = p.repository_id AND x.ref = p.new_ref AND x.oid = r.oid))"""


@register("reachable", oracle="SELECT repository_id, ref, oid FROM reach")
def reachable(spark, d):
    """G1: every commit reachable from every branch tip."""
    return graph_and_reach(spark, d)[1]


def _walk(spark, d, **limits):
    return G.walk(*graph_frontier(spark, d), **limits)


@register("rev_list", oracle=WALK_SQL + """
SELECT repository_id, ref, oid, committer_time, walk_rank FROM walk WHERE n_parents <= 1""")
def rev_list(spark, d):
    """The time-ordered walk of every branch, merges dropped."""
    return _walk(spark, d)


@register("rev_list_top", oracle=WALK_SQL + f"""
SELECT repository_id, ref, oid, committer_time, walk_rank FROM walk WHERE walk_rank <= {TOP} AND n_parents <= 1""")
def rev_list_top(spark, d):
    """G2/T6 with the caller's cap: merges count towards it and are dropped after it."""
    return _walk(spark, d, limit=TOP)


@register("incremental_exact", oracle=WALK_SQL + f"""
SELECT w.repository_id, w.ref, w.oid, w.committer_time, w.walk_rank FROM walk w
WHERE w.n_parents <= 1
  AND NOT EXISTS (SELECT 1 FROM fx_commits c WHERE c.repository_id = w.repository_id AND c.branch = w.ref AND c.oid = w.oid
                  AND c.committer_time < TIMESTAMP '{SPLIT}')""")
def incremental_exact(spark, d):
    """J5 exact / ST4: walked commits not yet indexed on their branch (late merge-ins kept)."""
    return _walk(spark, d, indexed=fx.fx_commits(spark, d).where(F.col("committer_time") < F.lit(SPLIT).cast("timestamp_ntz")))


@register("incremental_cut", oracle=WALK_SQL + f""",
since AS (
  SELECT repository_id, branch AS ref, oid AS since_oid FROM (
    SELECT *, row_number() OVER (PARTITION BY repository_id, branch ORDER BY committer_time DESC, oid) AS rn
    FROM fx_commits WHERE committer_time < TIMESTAMP '{SPLIT}') t WHERE rn = 1),
cut AS (SELECT w.repository_id, w.ref, w.walk_rank AS cut_rank FROM walk w
        JOIN since s ON s.repository_id = w.repository_id AND s.ref = w.ref AND s.since_oid = w.oid)
SELECT w.repository_id, w.ref, w.oid, w.committer_time, w.walk_rank FROM walk w
LEFT JOIN cut c ON c.repository_id = w.repository_id AND c.ref = w.ref
WHERE (c.cut_rank IS NULL OR w.walk_rank < c.cut_rank) AND w.n_parents <= 1""")
def incremental_cut(spark, d):
    """J5 cut / G2 since: the original stop-at-newest-indexed walk."""
    index = fx.fx_commits(spark, d).where(F.col("committer_time") < F.lit(SPLIT).cast("timestamp_ntz"))
    since = Q.latest_commit(index).select("repository_id", F.col("branch").alias("ref"), F.col("oid").alias("since_oid"))
    return _walk(spark, d, since=since)


RANGE_SQL = PAIRS_SQL + """
SELECT repository_id, old_ref, new_ref, oid, committer_time FROM (
  SELECT o.*, h.committer_time,
         row_number() OVER (PARTITION BY o.repository_id, o.old_ref, o.new_ref ORDER BY h.committer_time DESC, o.oid) AS rn
  FROM only_new o JOIN fx_history h ON h.repository_id = o.repository_id AND h.oid = o.oid WHERE h.n_parents <= 1) t"""


def _range(spark, d, limit=None):
    g, front = graph_frontier(spark, d)
    pairs = _pairs(spark, d)
    only_new = g.nodes_in(G.frontier_difference(front, pairs, "new_ref", "old_ref"), ["repository_id", "old_ref", "new_ref"])
    return G.range_from_set(only_new, _attrs(spark, d), limit=limit).select(
        "repository_id", "old_ref", "new_ref", "oid", "committer_time")


@register("range_commits", oracle=RANGE_SQL)
def range_commits(spark, d):
    """Main..branch for every non-default branch, no merges -
    enumerated from frontier intervals (only the differing commits)."""
    return _range(spark, d)


@register("range_commits_top", oracle=RANGE_SQL + f" WHERE rn <= {TOP}")
def range_commits_top(spark, d):
    """J2/U2 with the caller's limit: the newest of each range."""
    return _range(spark, d, limit=TOP)


@register("merge_status", oracle=PAIRS_SQL + """
SELECT *, CASE WHEN behind = 0 THEN 'up_to_date' WHEN ahead = 0 THEN 'fast_forward' ELSE 'diverged' END AS status FROM (
  SELECT p.repository_id, p.old_ref AS target_ref, p.new_ref AS source_ref,
         (SELECT count(*) FROM only_old o WHERE o.repository_id = p.repository_id AND o.old_ref = p.old_ref AND o.new_ref = p.new_ref) AS ahead,
         (SELECT count(*) FROM only_new o WHERE o.repository_id = p.repository_id AND o.old_ref = p.old_ref AND o.new_ref = p.new_ref) AS behind
  FROM gpairs p) t""")
def merge_status(spark, d):
    """Merging each branch into the default branch: ahead/behind and
    status, counted from frontier intervals."""
    _, front = graph_frontier(spark, d)
    return G.ahead_behind(front, _pairs(spark, d, old="target_ref", new="source_ref"))


@register("common_history", oracle="""
SELECT a.repository_id, p.new_branch AS a_ref, p.old_branch AS b_ref, a.oid
FROM fx_pairs p JOIN reach a ON a.repository_id = p.repository_id AND a.ref = p.new_branch
WHERE EXISTS (SELECT 1 FROM reach b WHERE b.repository_id = p.repository_id AND b.ref = p.old_branch AND b.oid = a.oid)""")
def common_history(spark, d):
    """Commits shared by the default branch and each other branch."""
    g, front = graph_frontier(spark, d)
    iv = G.frontier_intersection(front, _pairs(spark, d, old="a_ref", new="b_ref"), "a_ref", "b_ref")
    return g.nodes_in(iv, ["repository_id", "a_ref", "b_ref"])


FP_SQL = r""",
fp AS (
  SELECT repository_id, commit_oid AS oid, string_agg(path || '|' || f, chr(10) ORDER BY path) AS f FROM (
    SELECT repository_id, commit_oid, path, array_to_string(list_filter(list_transform(range(1, 4), lambda i:
             CASE WHEN old_lines[i] IS DISTINCT FROM new_lines[i]
                  THEN coalesce('-' || regexp_replace(old_lines[i], '\s+', '', 'g'), '') || coalesce('+' || regexp_replace(new_lines[i], '\s+', '', 'g'), '') END),
             lambda x: x IS NOT NULL), chr(10)) AS f
    FROM fx_commit_changes) t
  GROUP BY repository_id, commit_oid),
flagged AS (
  SELECT DISTINCT o.repository_id, o.new_ref AS old_ref, o.old_ref AS new_ref, o.oid
  FROM only_new o JOIN fp a ON a.repository_id = o.repository_id AND a.oid = o.oid
  WHERE EXISTS (SELECT 1 FROM only_old n JOIN fp b ON b.repository_id = n.repository_id AND b.oid = n.oid
                WHERE n.repository_id = o.repository_id AND n.old_ref = o.old_ref AND n.new_ref = o.new_ref AND b.f = a.f)),
diffrows AS (
  SELECT * FROM (
    SELECT c.repository_id, c.branch AS old_branch, p.new_branch, c.oid, c.committer_time,
           row_number() OVER (PARTITION BY c.repository_id, c.branch, p.new_branch ORDER BY c.committer_time DESC, c.oid) AS rn
    FROM fx_commits c JOIN fx_pairs p ON p.repository_id = c.repository_id AND p.old_branch = c.branch
    LEFT JOIN fx_commits n ON n.repository_id = c.repository_id AND n.branch = p.new_branch
                          AND n.author_time = c.author_time AND n.summary = c.summary
    WHERE n.oid IS NULL) t),
flagged_rows AS (
  SELECT r.*, EXISTS (SELECT 1 FROM flagged f WHERE f.repository_id = r.repository_id AND f.old_ref = r.old_branch
                      AND f.new_ref = r.new_branch AND f.oid = r.oid) AS is_empty
  FROM diffrows r)"""


def _flagged(spark, d):
    """J3 over every (branch, default branch) pair; both sides of the
    symmetric difference come from frontier intervals."""
    g, front = graph_frontier(spark, d)
    pairs = Q.default_branch_pairs(fx.fx_repositories(spark, d), fx.fx_branches(spark, d)).select(
        "repository_id", F.col("old_branch").alias("old_ref"), F.col("new_branch").alias("new_ref"))
    k = ["repository_id", "old_ref", "new_ref"]
    only_old = g.nodes_in(G.frontier_difference(front, pairs, "old_ref", "new_ref"), k)
    only_new = g.nodes_in(G.frontier_difference(front, pairs, "new_ref", "old_ref"), k)
    # only the patches of commits that one side lacks are aligned and hashed, each once
    differing = only_old.select("repository_id", F.col("oid").alias("commit_oid")).union(only_new.select("repository_id", "oid")).distinct()
    changes = history_changes(spark, d).join(differing, ["repository_id", "commit_oid"], "left_semi")
    fps = D.commit_fingerprints(changes, fx.fx_history_blobs(spark, d))
    return D.flag_equivalent_sets(only_old, only_new, fps)


def _flagged_diff_rows(spark, d):
    rows = Q.branch_diff(fx.fx_commits(spark, d),
                         Q.default_branch_pairs(fx.fx_repositories(spark, d), fx.fx_branches(spark, d)), limit=None)
    fl = _flagged(spark, d).select("repository_id", F.col("old_ref").alias("old_branch"),
                                   F.col("new_ref").alias("new_branch"), "oid", F.lit(True).alias("_hit"))
    return (rows.join(fl, ["repository_id", "old_branch", "new_branch", "oid"], "left")
            .withColumn("is_empty", F.coalesce("_hit", F.lit(False))).drop("_hit"))


@register("flag_equivalent", oracle=PAIRS_SQL + FP_SQL + """
SELECT repository_id, old_ref, new_ref, oid FROM flagged""")
def flag_equivalent(spark, d):
    """Commits only on a branch whose patch is already on the default branch."""
    return _flagged(spark, d)


@register("equivalent_oids", oracle=PAIRS_SQL + FP_SQL + """
SELECT DISTINCT repository_id, oid FROM flagged""")
def equivalent_oids(spark, d):
    """A5: distinct oids flagged as already picked."""
    return Q.distinct_oids(_flagged(spark, d))


@register("diff_totals", oracle=PAIRS_SQL + FP_SQL + """
SELECT repository_id, old_branch, new_branch, count(*) AS found, count(*) FILTER (WHERE is_empty) AS picked
FROM flagged_rows GROUP BY repository_id, old_branch, new_branch""")
def diff_totals(spark, d):
    """A4: per pair, commits found by J1 and how many J3 flags as already picked."""
    return Q.diff_totals(_flagged_diff_rows(spark, d))


@register("pick_order", oracle=PAIRS_SQL + FP_SQL + """
SELECT repository_id, old_branch, new_branch, oid,
       row_number() OVER (PARTITION BY repository_id, old_branch, new_branch ORDER BY committer_time, oid DESC) AS pick_seq
FROM flagged_rows WHERE NOT is_empty""")
def pick_order(spark, d):
    """Unflagged diff rows oldest first, numbered per pair."""
    return Q.pick_order(_flagged_diff_rows(spark, d)).select(
        "repository_id", "old_branch", "new_branch", "oid", "pick_seq")


@register("match_oid_prefix", oracle="""
SELECT l.repository_id, l.oid, r.abbrev AS matched_oid FROM
  (SELECT DISTINCT repository_id, oid FROM fx_commits WHERE branch = 'origin/release') l
JOIN (SELECT DISTINCT repository_id, substr(oid, 1, CASE event_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 7 ELSE 12 END) AS abbrev FROM fx_nodes WHERE lane = 1) r
  ON l.repository_id = r.repository_id AND (starts_with(l.oid, r.abbrev) OR starts_with(r.abbrev, l.oid))""")
def match_oid_prefix(spark, d):
    """Two-way prefix match of full oids against abbreviations of 4, 7 and 12 characters of the same repository."""
    left = fx.fx_commits(spark, d).where(F.col("branch") == "origin/release").select("repository_id", "oid").distinct()
    n = fx.fx_nodes(spark, d).where(F.col("lane") == 1)
    length = F.when(F.col("event_id") % 3 == 0, 4).when(F.col("event_id") % 3 == 1, 7).otherwise(12)
    right = n.select("repository_id", F.left(F.col("oid"), length).alias("oid")).distinct()
    return Q.match_oid_prefix(left, right).select("repository_id", "oid", "matched_oid")

@register("reachable_incremental", oracle="SELECT repository_id, ref, oid FROM reach")
def reachable_incremental(spark, d):
    """G1 incremental: index the history before the split, extend it with the
    later commits (only those are ranked), answer for every branch tip."""
    h = fx.fx_history(spark, d)
    e = fx.fx_commit_parents(spark, d)
    cut = F.lit(SPLIT).cast("timestamp_ntz")
    old = h.where(F.col("committer_time") < cut).select("repository_id", "oid", "committer_time")
    new = h.where(F.col("committer_time") >= cut).select("repository_id", "oid", "committer_time")
    old_e = e.join(old.drop("committer_time"), ["repository_id", "oid"], "left_semi")
    new_e = e.join(new.drop("committer_time"), ["repository_id", "oid"], "left_semi")
    g = G.CommitGraph(old, old_e).extend(new, new_e)
    refs = fx.fx_branches(spark, d).select("repository_id", F.col("name").alias("ref"), "target_oid")
    return g.reachable(refs)


SHALLOW = "2024-01-10 00:00:00"


@register("shallow_dangling", oracle=f""",
kept AS (SELECT repository_id, oid FROM fx_history WHERE committer_time >= TIMESTAMP '{SHALLOW}')
SELECT e.repository_id, e.oid, e.pos, e.parent_oid FROM fx_commit_parents e
JOIN kept k ON k.repository_id = e.repository_id AND k.oid = e.oid
WHERE NOT EXISTS (SELECT 1 FROM kept p WHERE p.repository_id = e.repository_id AND p.oid = e.parent_oid)""")
def shallow_dangling(spark, d):
    """G1 input check on a shallow export (history from 2024-01-10 on): edges
    whose parent is not in the export end their chain and are reported."""
    h = fx.fx_history(spark, d).where(F.col("committer_time") >= F.lit(SHALLOW).cast("timestamp_ntz"))
    kept = h.select("repository_id", "oid")
    edges = fx.fx_commit_parents(spark, d).join(kept, ["repository_id", "oid"], "left_semi")
    return G.CommitGraph(kept, edges).dangling()
