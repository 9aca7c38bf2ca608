"""Line diff helpers against brute force, and tree diff semantics."""
import random

from strata.operators import diff as D


def lcs_dp(a, b):
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            dp[i + 1][j + 1] = dp[i][j] + 1 if a[i] == b[j] else max(dp[i][j + 1], dp[i + 1][j])
    return dp[-1][-1]


def test_lcs_matches_dp_and_align_is_minimal():
    rnd = random.Random(3)
    for _ in range(400):
        a = [rnd.choice("abcd") for _ in range(rnd.randrange(0, 30))]
        b = [rnd.choice("abcd") for _ in range(rnd.randrange(0, 30))]
        lcs = lcs_dp(a, b)
        assert D.lcs_length(a, b) == lcs
        script = D.align(a, b)
        assert sum(o == " " for o, _ in script) == lcs
        assert [t for o, t in script if o != "+"] == a and [t for o, t in script if o != "-"] == b


def _changes(spark, rows):
    return spark.createDataFrame(rows, "pair_id string, path string, status string, old_blob string, new_blob string, "
                                       "old_content string, new_content string")


def test_counts_bounds_and_edge_cases(spark):
    rows = [("p", "mod", "Modified", "o1", "n1", "a\nb\nc\nb\n", "b\na\nc\nb\nx"),
            ("p", "dup", "Modified", "o2", "n2", "x\nx\nx", "x"),
            ("p", "new", "Added", None, "n3", None, "l1\nl2\n"),
            ("p", "bin", "Modified", "o4", "n4", "a\x00b", "a\x00c"),
            ("p", "ws", "Modified", "o5", "n5", "a b", "a  b")]
    rows += [("p", "eof", "Modified", "o6", "n6", "a\nb\n", "a\nb"), ("p", "bigbin", "Modified", "o7", "n7", "a\n" * 21000 + "\x00", "b\x00")]
    cw = _changes(spark, rows)
    blobs = spark.createDataFrame([(r[k], r[k + 2]) for r in rows for k in (3, 4) if r[k]], "blob_oid string, content string")
    changes = cw.select("pair_id", "path", "status", "old_blob", "new_blob")
    d1 = {r["path"]: (r["insertions"], r["deletions"]) for r in D.line_change_counts(changes, blobs).collect()}
    assert d1["eof"] == (1, 1) and d1["bigbin"] == (0, 0)
    d2 = {r["path"]: (r["insertions"], r["deletions"]) for r in D.line_multiset_changes(cw).collect()}
    assert d1["new"] == (2, 0) and d1["dup"] == (0, 2) and d1["bin"] == (0, 0) and d1["ws"] == (1, 1)
    for path in ["mod", "dup", "new", "ws"]:
        assert d2[path][0] <= d1[path][0] and d2[path][1] <= d1[path][1]
    old_n, new_n = 4, 5
    assert d1["mod"][0] - d1["mod"][1] == new_n - old_n
    lines = D.diff_lines(changes, blobs).where("path = 'mod'").orderBy("seq").collect()
    assert sum(r["origin"] == "+" for r in lines) == d1["mod"][0]


def test_large_files_are_exact():
    a = [str(i) for i in range(50_000)]
    assert D.lcs_length(a, a[::-1]) == 1
    rnd = random.Random(4)
    x, y = [[rnd.choice("abcdefgh") for _ in range(5000)] for _ in range(2)]
    script = D.align(x, y)
    assert [t for o, t in script if o != "+"] == x and [t for o, t in script if o != "-"] == y
    assert sum(o == " " for o, _ in script) == D.lcs_length(x, y)


def test_patch_of_batches_without_lines(spark):
    changes = spark.createDataFrame([("p", "bin", "Modified", "o", "n")], "pair_id string, path string, status string, old_blob string, new_blob string")
    blobs = spark.createDataFrame([("o", "a\x00"), ("n", "b\x00")], "blob_oid string, content string")
    assert D.diff_lines(changes, blobs).count() == 0


def test_commit_against_first_parent(spark):
    feed = spark.createDataFrame([(1, "c1", []), (1, "c2", ["c1", "x"]), (1, "c3", ["c2"])], "repository_id long, oid string, parent_oids array<string>")
    te = spark.createDataFrame([(1, "c1", "f", "b1"), (1, "c2", "f", "b2"), (1, "c3", "f", "b3")], "repository_id long, commit_oid string, path string, blob_oid string")
    blobs = spark.createDataFrame([("b1", "x\n"), ("b2", "x\ny\n"), ("b3", "x\ny\nz\n")], "blob_oid string, content string")
    lines = D.commit_patch_lines(feed, te, blobs)
    got = sorted((r["commit_oid"], r["origin"], r["content"]) for r in lines.where("origin <> ' '").collect())
    assert got == [("c1", "+", "x"), ("c2", "+", "y"), ("c3", "+", "z")]
    assert D.patch_fingerprints(lines).count() == 3


def test_tree_diff_move_is_delete_plus_add(spark):
    te = spark.createDataFrame([(1, "c1", "a.txt", "b1"), (1, "c1", "same", "s"), (1, "c2", "moved/a.txt", "b1"), (1, "c2", "same", "s")],
                               "repository_id long, commit_oid string, path string, blob_oid string")
    pairs = spark.createDataFrame([("x", 1, "c1", "c2"), ("root", 1, None, "c1")],
                                  "pair_id string, repository_id long, from_oid string, to_oid string")
    got = sorted((r["pair_id"], r["path"], r["status"]) for r in D.file_changes(te, pairs).collect())
    assert got == [("root", "a.txt", "Added"), ("root", "same", "Added"),
                   ("x", "a.txt", "Deleted"), ("x", "moved/a.txt", "Added")]


def test_whitespace_only_change_is_equivalent(spark):
    lines = spark.createDataFrame(
        [(1, "c1", "f", 0, "+", "x = 1"), (1, "c1", "f", 1, "-", "y"), (1, "c2", "f", 0, "+", "x=1  "), (1, "c2", "f", 1, "-", "y"),
         (1, "c3", "f", 0, "+", "x = 2")],
        "repository_id long, commit_oid string, path string, seq int, origin string, content string")
    fp = {r["commit_oid"]: r["fp_sum"] for r in D.patch_fingerprints(lines).collect()}
    assert fp["c1"] == fp["c2"] != fp["c3"]


def test_greedy_search_finds_the_edit_distance_and_its_middle():
    import numpy as np

    rnd = random.Random(8)
    for _ in range(600):
        a = [rnd.randrange(4) for _ in range(rnd.randrange(1, 14))]
        b = [rnd.randrange(4) for _ in range(rnd.randrange(1, 14))]
        d, x, y, u, v = D.middle_snake(np.array(a), np.array(b))
        dist = lambda p, q: len(p) + len(q) - 2 * lcs_dp(p, q)
        assert d == dist(a, b) and a[x:u] == b[y:v]
        assert dist(a[:x], b[:y]) + dist(a[u:], b[v:]) == d
    assert D.middle_snake(np.arange(500), np.arange(500)[::-1].copy(), budget=100) is None


def test_both_ways_of_alignment_are_minimal(monkeypatch):
    rnd = random.Random(9)
    for budget in (0, 10 ** 9):
        monkeypatch.setattr(D, "_budget", lambda n, m, budget=budget: budget)
        for _ in range(150):
            a = [rnd.choice("abcd") for _ in range(rnd.randrange(0, 30))]
            b = [rnd.choice("abcd") for _ in range(rnd.randrange(0, 30))]
            script = D.align(a, b)
            assert sum(o == " " for o, _ in script) == lcs_dp(a, b) == D.lcs_length(a, b)
            assert [t for o, t in script if o != "+"] == a and [t for o, t in script if o != "-"] == b


def test_large_near_equal_files_take_seconds():
    import time

    rnd = random.Random(10)
    a = [f"line {i} {rnd.randrange(50)}" for i in range(200_000)]
    b = list(a)
    for k in rnd.sample(range(200_000), 50):
        b[k] = "edited %d" % k
    t = time.time()
    script = D.align(a, b)
    assert sum(o == "-" for o, _ in script) == sum(o == "+" for o, _ in script) == 50 and D.lcs_length(a, b) == 199_950
    assert time.time() - t < 20


def _sides(spark, files):
    rows = [(p, o, n) for p, (o, n) in files.items()]
    return spark.createDataFrame(rows, "path string, old string, new string")


def test_patches_rebuild_both_sides(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(11)
    text = lambda: "\n".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 40))) + rnd.choice(["", "\n"])
    files = {f"f{i}": (text(), text()) for i in range(60)}
    files |= {"same": ("a\nb\n", "a\nb\n"), "eof": ("a\nb\n", "a\nb"), "new": ("", "x\ny"), "gone": ("x\n", ""), "blank": ("\n\n", "\n"), "none": ("", "")}
    sides = _sides(spark, files)
    rows = [(p, *r) for p, (o, n) in files.items() for r in D.patch_rows(o, n)]
    patch = spark.createDataFrame(rows, "path string, " + D.PATCH_SCHEMA)
    there = D.patched(sides.select("path", F.col("old").alias("content")), patch, ["path"])
    back = D.patched(sides.select("path", F.col("new").alias("content")), patch, ["path"], reverse=True)
    assert {r["path"]: r["content"] for r in there.collect()} == {p: n for p, (_, n) in files.items()}
    assert {r["path"]: r["content"] for r in back.collect()} == {p: o for p, (o, _) in files.items()}


def test_tree_diff_opens_only_directories_that_differ(spark):
    """Random listings: same changes as the whole-listing diff, few directories read, kinds that change."""
    from pyspark.sql import functions as F

    from strata.operators import trees as T

    rnd = random.Random(12)
    now = {f"d{i % 7}/e{i % 3}/f{i}": "b0" for i in range(200)} | {"top": "b0"}
    listings = {"c0": dict(now)}
    for k in range(1, 6):
        for p in rnd.sample(sorted(now), 3):
            now[p] = f"b{k}"
        listings[f"c{k}"] = dict(now)
    del now["top"], now["d0/e0/f0"]
    now |= {"top/inside": "b9", "d0/e0/f0x": "b9"}  # a file becomes a directory, another is renamed
    listings["c6"] = dict(now)
    rows = [(1, c, p, b) for c, files in listings.items() for p, b in files.items()]
    entries = spark.createDataFrame(rows, "repository_id long, commit_oid string, path string, blob_oid string")
    names = sorted(listings)
    pairs = spark.createDataFrame([(f"{a}-{b}", 1, a, b) for a, b in [(None, "c0"), *zip(names, names[1:]), ("c0", "c6"), ("c3", "c3"), ("c6", "zz")]],
                                  "pair_id string, repository_id long, from_oid string, to_oid string")
    trees, roots = T.trees_of(entries, ["repository_id", "commit_oid"])
    got = T.tree_changes(trees, roots, pairs).collect()
    want = D.file_changes(entries, pairs).collect()
    key = lambda r: (r["pair_id"], r["path"], r["old_blob"], r["new_blob"], r["status"])
    assert sorted(map(key, got), key=str) == sorted(map(key, want), key=str) and len(got) > 400
    # what one comparison of neighbours opens: a directory a level and changed file at most, of 200 entries a side
    step = roots.where("commit_oid IN ('c1', 'c2')").orderBy("commit_oid").collect()
    pair = spark.createDataFrame([(step[0]["root_oid"], step[1]["root_oid"])], "old string, new string")
    opened = 0
    while not pair.isEmpty():
        oids = pair.select(F.col("old").alias("tree_oid")).union(pair.select("new")).distinct()
        opened += trees.join(oids, "tree_oid", "left_semi").count()
        diff = T.directory_diff(trees, pair)
        pair = diff.where("old_kind = 'tree' OR new_kind = 'tree'").select(F.col("old_oid").alias("old"), F.col("new_oid").alias("new"))
    assert opened < 150
    assert trees.count() < entries.count() / 2


def test_a_level_in_stretches_gives_the_same_rows_and_holds_less(spark, monkeypatch):
    """Levels worked off in stretches find what listings differ in; listings and the
    pairs of finished levels are gone before the result is written."""
    import glob
    from strata.operators import trees as T
    from strata.session import ensure_checkpoint_dir

    names = [f"c{i}" for i in range(5)]
    rows = [(1, c, f"d{j % 4}/e{j % 3}/f{j}", f"b{j}" if (i + j) % 5 else f"b{j}-{i}") for i, c in enumerate(names) for j in range(40) if (i + j) % 11]
    rows += [(1, "c2", "x", "file"), (1, "c3", "x/y", "inside")]
    entries = spark.createDataFrame(rows, "repository_id long, commit_oid string, path string, blob_oid string")
    pairs = spark.createDataFrame([(f"{k}:{a}-{b}", 1, a, b) for k, (a, b) in enumerate([(None, "c0"), *zip(names, names[1:]), ("c4", "zz"), ("c0", "c1")])],
                                  "pair_id string, repository_id long, from_oid string, to_oid string")
    trees, roots = T.trees_of(entries, ["repository_id", "commit_oid"])
    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    lies = lambda: set(glob.glob(f"{base}/trees-*")) | set(glob.glob(f"{base}/graph-*/what=tree"))
    before, seen, cut = lies(), [], T._cut
    monkeypatch.setattr(T, "STRETCH", 2, raising=False)
    monkeypatch.setattr(T, "_cut", lambda *a: (seen.append(lies() - before), cut(*a))[1])
    got = T.tree_changes(trees, roots, pairs).collect()
    key = lambda r: (r["pair_id"], r["path"], r["old_blob"], r["new_blob"], r["status"])
    want = D.file_changes(entries, pairs).collect()
    assert sorted(map(key, got), key=str) == sorted(map(key, want), key=str) and len(got) > 100
    assert len(seen[-1]) <= 1 and not any("/trees-" in f for x in seen for f in x) and lies() == before


def test_levels_of_small_shuffles_are_one_pass_and_pairs_come_along(spark, monkeypatch):
    """A level whose shuffles are smaller than the listings is not cut; entries meet by name, whatever it holds;
    only directories that several pairs share are joined to them."""
    from strata.operators import trees as T

    names = ["a", "a b", "a  b", "a\nb", "é", "z"]
    top = lambda k: [(f"r{k}", "sub dir", "tree", f"t{k}"), (f"r{k}", "kept", "blob", "same")]
    sub = [(f"t{k}", n, "blob", f"b{i}{k if (i + k) % 2 else ''}") for k in range(6) for i, n in enumerate(names) if (i + k) % 5]
    bulk = [(f"x{i}", f"name{i}", "blob", f"{i:040d}") for i in range(3000)]
    trees = spark.createDataFrame([*(x for k in range(6) for x in top(k)), *sub, *bulk], "tree_oid string, name string, kind string, child_oid string")
    roots = spark.createDataFrame([(1, f"c{k}", f"r{k}") for k in range(6)], "repository_id long, commit_oid string, root_oid string")
    steps = [(f"c{k}", f"c{k + 1}") for k in range(5)] * 2 + [(None, "c0"), ("c5", None), ("c3", "zz")]
    pairs = spark.createDataFrame([(f"p{i}", 1, a, b) for i, (a, b) in enumerate(steps)], "pair_id string, repository_id long, from_oid string, to_oid string")
    passes, diff, done = [], T.listing_diff, []
    monkeypatch.setattr(T, "STRETCH", 2)
    monkeypatch.setattr(T, "listing_diff", lambda *a: (passes.append(1), diff(*a))[1])
    got = T.tree_changes(trees, roots, pairs, read=lambda: done.append(1)).collect()
    files = {f"c{k}": {"kept": "same"} | {f"sub dir/{n}": o for t, n, _, o in sub if t == f"t{k}"} for k in range(6)}
    want = set()
    for i, (a, b) in enumerate(steps):
        old, new = files.get(a, {}), files.get(b, {})
        want |= {(f"p{i}", p, old.get(p), new.get(p)) for p in old.keys() | new.keys() if old.get(p) != new.get(p)}
    assert {(r["pair_id"], r["path"], r["old_blob"], r["new_blob"]) for r in got} == want and len(got) == len(want)
    assert len(passes) == 2 and done == [1]
