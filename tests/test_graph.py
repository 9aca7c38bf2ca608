"""Reachability and walks on hand fixtures and random DAGs, against brute force."""
import random

from pyspark.sql import functions as F

import reach_sets as sets

from strata.operators import graph as G


def _bfs(parents, start):
    seen, stack = set(), [start]
    while stack:
        x = stack.pop()
        if x in seen or x not in parents:
            continue
        seen.add(x)
        stack.extend(parents[x])
    return seen


def _frames(spark, parents, repo=1):
    nodes = spark.createDataFrame([(repo, o) for o in parents], "repository_id long, oid string")
    edges = spark.createDataFrame([(repo, o, i, p) for o, ps in parents.items() for i, p in enumerate(ps)],
                                  "repository_id long, oid string, pos int, parent_oid string")
    return nodes, edges


def _reach(spark, parents, tips, **kw):
    nodes, edges = _frames(spark, parents)
    g = G.CommitGraph(nodes, edges, **kw)
    refs = spark.createDataFrame([(1, name, t) for name, t in tips.items()], "repository_id long, ref string, target_oid string")
    got = {}
    for r in g.reachable(refs).collect():
        got.setdefault(r["ref"], set()).add(r["oid"])
    return g, got


def test_root_merge_and_shallow(spark):
    # a <- b <- c (main);  b <- d <- e (side);  f merges c and e;  g has a missing parent (shallow)
    parents = {"a": [], "b": ["a"], "c": ["b"], "d": ["b"], "e": ["d"], "f": ["c", "e"], "g": ["zz"]}
    g, got = _reach(spark, parents, {"main": "f", "side": "e", "root": "a", "shallow": "g"})
    for ref, tip in {"main": "f", "side": "e", "root": "a", "shallow": "g"}.items():
        assert got[ref] == _bfs(parents, tip), ref
    assert g.dangling().count() == 1


def _random_parents(rnd, n, back, share, after):
    parents = {}
    for i in range(n):
        ps = []
        if i > 0:
            ps.append(f"n{rnd.randrange(max(0, i - back), i):03d}")
            if rnd.random() < share and i > after:
                ps.append(f"n{rnd.randrange(0, i):03d}")
        parents[f"n{i:03d}"] = ps
    return parents


def test_random_dags_match_bfs(spark):
    """Several random histories, one repository each, in one index."""
    rnd = random.Random(7)
    repos = {repo: _random_parents(rnd, 120, 1 + repo, 0.2, 10) for repo in range(1, 7)}
    nodes, edges = _frames(spark, repos[1], 1)
    for repo in range(2, 7):
        n, e = _frames(spark, repos[repo], repo)
        nodes, edges = nodes.union(n), edges.union(e)
    tips = {(repo, f"t{k}"): f"n{rnd.randrange(120):03d}" for repo in repos for k in range(6)}
    refs = spark.createDataFrame([(repo, name, t) for (repo, name), t in tips.items()], "repository_id long, ref string, target_oid string")
    g = G.CommitGraph(nodes, edges, bucket=16)
    got = {}
    for r in g.reachable(refs).collect():
        got.setdefault((r["repository_id"], r["ref"]), set()).add(r["oid"])
    for key, tip in tips.items():
        assert got[key] == _bfs(repos[key[0]], tip), key


def test_rounds_keep_the_planned_size_small(spark):
    """A long path takes many rounds; the planner's size estimate follows the files, not the rounds."""
    n = 3000
    nodes = spark.range(n).selectExpr("1L as repository_id", "format_string('n%05d', id) as oid")
    edges = spark.range(1, n).selectExpr("1L as repository_id", "format_string('n%05d', id) as oid", "0 as pos", "format_string('n%05d', id - 1) as parent_oid")
    g = G.CommitGraph(nodes, edges)
    size = int(str(g.index()._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert g.rounds["doubling"] >= 12 and size < 10_000_000
    assert g.index().agg(F.max("cpos")).first()[0] == n - 1


def _attrs(spark, parents, times):
    return spark.createDataFrame([(1, o, times[o], ps) for o, ps in parents.items()],
                                 "repository_id long, oid string, committer_time long, parent_oids array<string>")


def test_rev_list_cap_since_and_merges(spark):
    # linear a..e, with m a merge of d and x; times increase; ties broken by oid
    parents = {"a": [], "b": ["a"], "c": ["b"], "x": ["b"], "d": ["c"], "m": ["d", "x"], "e": ["m"]}
    times = {"a": 1, "b": 2, "c": 3, "x": 3, "d": 4, "m": 5, "e": 6}
    nodes, edges = _frames(spark, parents)
    g = G.CommitGraph(nodes, edges)
    refs = spark.createDataFrame([(1, "main", "e")], "repository_id long, ref string, target_oid string")
    attrs = _attrs(spark, parents, times)
    walk = [r["oid"] for r in G.rev_list(g, refs, attrs).orderBy("walk_rank").collect()]
    assert walk == ["e", "d", "c", "x", "b", "a"]            # merge m dropped, tie c/x by oid
    capped = [r["oid"] for r in G.rev_list(g, refs, attrs, limit=3).orderBy("walk_rank").collect()]
    assert capped == ["e", "d"]                              # the merge counts toward the cap
    since = spark.createDataFrame([(1, "main", "c")], "repository_id long, ref string, since_oid string")
    cut = [r["oid"] for r in G.rev_list(g, refs, attrs, since=since).orderBy("walk_rank").collect()]
    assert cut == ["e", "d"]
    at_tip = spark.createDataFrame([(1, "main", "e")], "repository_id long, ref string, since_oid string")
    assert G.rev_list(g, refs, attrs, since=at_tip).count() == 0
    absent = spark.createDataFrame([(1, "main", "nope")], "repository_id long, ref string, since_oid string")
    assert G.rev_list(g, refs, attrs, since=absent).count() == 6


def test_late_merge_in_exact_vs_cut(spark):
    # side commit s (old time) merged into main after the index saw main up to d
    parents = {"a": [], "d": ["a"], "s": ["a"], "m": ["d", "s"], "e": ["m"]}
    times = {"a": 1, "s": 2, "d": 3, "m": 4, "e": 5}
    nodes, edges = _frames(spark, parents)
    g = G.CommitGraph(nodes, edges)
    refs = spark.createDataFrame([(1, "main", "e")], "repository_id long, ref string, target_oid string")
    walk = G.rev_list(g, refs, _attrs(spark, parents, times))
    index = spark.createDataFrame([(1, "main", "a", 1), (1, "main", "d", 3)],
                                  "repository_id long, branch string, oid string, committer_time long")
    exact = {r["oid"] for r in G.incremental_cut(walk, index, "exact").collect()}
    cut = {r["oid"] for r in G.incremental_cut(walk, index, "cut").collect()}
    assert exact == {"e", "s"}      # the late merged-in commit is kept
    assert cut == {"e"}             # the original cut never sees it


def test_range_common_and_status(spark):
    parents = {"a": [], "b": ["a"], "c": ["b"], "d": ["b"], "e": ["d"]}
    times = {k: i for i, k in enumerate("abcde")}
    nodes, edges = _frames(spark, parents)
    g = G.CommitGraph(nodes, edges)
    refs = spark.createDataFrame([(1, "main", "c"), (1, "dev", "e"), (1, "old", "b")],
                                 "repository_id long, ref string, target_oid string")
    reach = g.reachable(refs)
    pairs = spark.createDataFrame([(1, "main", "dev")], "repository_id long, old_ref string, new_ref string")
    rng = {r["oid"] for r in sets.range_commits(reach, pairs, _attrs(spark, parents, times)).collect()}
    common = sets.common_history(reach, pairs.select("repository_id", F.col("old_ref").alias("a_ref"), F.col("new_ref").alias("b_ref")))
    assert rng == {"d", "e"}
    assert len(rng) + common.count() == len(_bfs(parents, "e"))
    st = spark.createDataFrame([(1, "main", "dev"), (1, "main", "old"), (1, "old", "main")],
                               "repository_id long, target_ref string, source_ref string")
    got = {(r["target_ref"], r["source_ref"]): (r["ahead"], r["behind"], r["status"]) for r in sets.merge_status(reach, st).collect()}
    assert got[("main", "dev")] == (1, 2, "diverged")
    assert got[("main", "old")] == (1, 0, "up_to_date")
    assert got[("old", "main")] == (0, 1, "fast_forward")


def test_incremental_extend_equals_full(spark):
    rnd = random.Random(11)
    n = 150
    parents = {}
    for i in range(n):
        ps = []
        if i > 0:
            ps.append(f"n{rnd.randrange(max(0, i - 4), i):03d}")
            if rnd.random() < 0.2 and i > 10:
                ps.append(f"n{rnd.randrange(0, i):03d}")
        parents[f"n{i:03d}"] = ps
    # a random split: some old commits have parents that only arrive with the new batch
    keys = sorted(parents)
    later = set(rnd.sample(keys, 50))
    old = {k: v for k, v in parents.items() if k not in later}
    new = {k: v for k, v in parents.items() if k in later}
    on0, oe0 = _frames(spark, old)
    assert G.CommitGraph(on0, oe0).dangling().count() > 0
    on, oe = _frames(spark, old)
    nn, ne = _frames(spark, new)
    g = G.CommitGraph(on, oe).extend(nn, ne)
    tips = {f"t{k}": f"n{rnd.randrange(n):03d}" for k in range(6)}
    refs = spark.createDataFrame([(1, name, t) for name, t in tips.items()], "repository_id long, ref string, target_oid string")
    got = {}
    for r in g.reachable(refs).collect():
        got.setdefault(r["ref"], set()).add(r["oid"])
    for ref, tip in tips.items():
        assert got[ref] == _bfs(parents, tip), ref
    # old coordinates did not move
    assert g.index().count() == n


def test_frontier_algebra_equals_sets(spark):
    rnd = random.Random(5)
    n = 100
    parents = {}
    for i in range(n):
        ps = []
        if i > 0:
            ps.append(f"n{rnd.randrange(max(0, i - 4), i):03d}")
            if rnd.random() < 0.25 and i > 8:
                ps.append(f"n{rnd.randrange(0, i):03d}")
        parents[f"n{i:03d}"] = ps
    nodes, edges = _frames(spark, parents)
    g = G.CommitGraph(nodes, edges, bucket=8)
    tips = {f"t{k}": f"n{rnd.randrange(n):03d}" for k in range(5)}
    refs = spark.createDataFrame([(1, r, t) for r, t in tips.items()], "repository_id long, ref string, target_oid string")
    front = g.frontier(refs)
    pairs = spark.createDataFrame([(1, a, b) for a in tips for b in tips if a != b],
                                  "repository_id long, target_ref string, source_ref string")
    got = {(r["target_ref"], r["source_ref"]): (r["ahead"], r["behind"]) for r in G.ahead_behind(front, pairs).collect()}
    for a in tips:
        for b in tips:
            if a != b:
                ra, rb = _bfs(parents, tips[a]), _bfs(parents, tips[b])
                assert got[(a, b)] == (len(ra - rb), len(rb - ra)), (a, b)
    diff = g.nodes_in(G.frontier_difference(front, pairs, "target_ref", "source_ref"), ["target_ref", "source_ref"])
    sets = {}
    for r in diff.collect():
        sets.setdefault((r["target_ref"], r["source_ref"]), set()).add(r["oid"])
    for (a, b), v in sets.items():
        assert v == _bfs(parents, tips[a]) - _bfs(parents, tips[b])


def test_feature_branch_history_needs_few_rounds(spark):
    """Merged feature branches: the trunk is one chain, so rounds do not grow with the forks."""
    n = 240
    edges = []
    for i in range(1, n + 1):  # m(i-1) <- f(i), m(i-1) <- m(i) -> f(i)
        edges += [(1, f"f{i}", 0, f"m{i - 1}"), (1, f"m{i}", 0, f"m{i - 1}"), (1, f"m{i}", 1, f"f{i}")]
    edges = spark.createDataFrame(edges, "repository_id long, oid string, pos int, parent_oid string")
    nodes = edges.select("repository_id", "oid").union(edges.select("repository_id", "parent_oid")).distinct()
    refs = spark.createDataFrame([(1, "main", f"m{n}"), (1, "half", f"f{n // 2}")], "repository_id long, ref string, target_oid string")
    g = G.CommitGraph(nodes, edges)
    front = g.frontier(refs)
    assert g.rounds["frontier"] <= 4 and g.rounds["doubling"] <= 11
    iv = front.selectExpr("repository_id", "ref", "chain", "-1 as lo", "max_pos as hi")
    got = {r["ref"]: r["n"] for r in g.nodes_in(iv, ["repository_id", "ref"]).groupBy("ref").agg(F.count("oid").alias("n")).collect()}
    assert got == {"main": 2 * n + 1, "half": 1 + 2 * (n // 2 - 1) + 1}


def test_walk_by_ids_matches_rev_list(spark):
    # equal times, merges, commits of two repositories; ids follow (time, oid), so the walk numbers rows without their names
    rnd = random.Random(15)
    parents = _random_parents(rnd, 60, 5, 0.3, 3)
    times = {o: i // 4 for i, o in enumerate(parents)}
    pairs = [_frames(spark, parents, repo) for repo in (1, 2)]
    nodes, edges = (pairs[0][i].unionByName(pairs[1][i]) for i in (0, 1))
    attrs = _attrs(spark, parents, times)
    attrs = attrs.unionByName(attrs.withColumn("repository_id", F.lit(2).cast("long")))
    g = G.CommitGraph(attrs.select("repository_id", "oid", "committer_time", (F.size("parent_oids") > 1).alias("is_merge")), edges)
    refs = spark.createDataFrame([(r, name, t) for r in (1, 2) for name, t in (("main", "n059"), ("dev", "n050"))], "repository_id long, ref string, target_oid string")
    since = spark.createDataFrame([(1, "main", "n030"), (2, "dev", "n055"), (2, "main", "nope")], "repository_id long, ref string, since_oid string")
    index = spark.createDataFrame([(r, b, o, times[o]) for r, b in ((1, "main"), (2, "dev")) for o in parents if rnd.random() < 0.6],
                                  "repository_id long, branch string, oid string, committer_time long")
    front, plain = g.frontier(refs), G.CommitGraph(nodes, edges)
    rows = lambda df: sorted(tuple(r) for r in df.select("repository_id", "ref", "oid", "committer_time", "walk_rank").collect())
    whole = G.rev_list(plain, refs, attrs)
    assert rows(G.walk(g, front)) == rows(whole)
    assert rows(G.walk(g, front, limit=7)) == rows(G.rev_list(plain, refs, attrs, limit=7))
    assert rows(G.walk(g, front, since=since)) == rows(G.rev_list(plain, refs, attrs, since=since))
    assert rows(G.walk(g, front, indexed=index)) == rows(G.incremental_cut(whole, index, "exact"))


def test_incremental_exact_numbers_rows_without_names(spark):
    from strata.plans.catalog import QUERIES

    plan = QUERIES["incremental_exact"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    windows = [line for line in str(plan).splitlines() if "Window" in line and "walk_rank" in line]
    assert windows and not any("oid" in line for line in windows)
    # dealt by ref, a row is its id; its name and the index are met a commit at a time
    assert not any("Join" in line and "oid#" in line and "ref#" in line for line in str(plan).splitlines())
