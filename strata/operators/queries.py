"""Read-path operators over the commit index, for all repositories and
branches in one job: branch difference (J1), paging and top-k (T1-T6),
counts (A1, A4, A5), per-branch windows (W1-W3), set operations (U1, U4),
branch summary (J8), commit detail join (J6/P11) and oid prefix match (J4).

Every per-group top-k is a ``row_number`` filter, which Spark plans as a
``WindowGroupLimit`` before the shuffle (map-side top-k), so one hot branch
never ships more than k rows per map task.  Ties always break on ``oid ASC``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import scalars as S
from strata.operators.tables import default_branch

DIFF_KEY = ("author_time", "summary")   # what the original SQL joins on (besides the repository)
SALTS = 16                              # parts of a branch that meet its pairs in tasks of their own


def _top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int | None,
           offset: int = 0, rank_col: str | None = None) -> DataFrame:
    """Rows ranked ``offset+1 .. offset+k`` per group (all rows when k is None)."""
    if k is None and not offset and rank_col is None:
        return df
    w = Window.partitionBy(*group).orderBy(*order)
    rn = F.row_number().over(w)
    name = rank_col or "_rn"
    out = df.withColumn(name, rn)
    if k is not None:
        out = out.where((F.col(name) > offset) & (F.col(name) <= offset + k))
    elif offset:
        out = out.where(F.col(name) > offset)
    return out if rank_col else out.drop(name)


# --- J1 branch difference --------------------------------------------------------

def default_branch_pairs(repositories: DataFrame, branches: DataFrame) -> DataFrame:
    """(repository_id, old_branch, new_branch): every branch against its
    repository's default branch - linear in the number of branches."""
    d = default_branch(repositories, branches)
    return (branches.select("repository_id", F.col("name").alias("old_branch"))
            .join(d, "repository_id")
            .where(F.col("old_branch") != F.col("default_branch"))
            .select("repository_id", "old_branch", F.col("default_branch").alias("new_branch")))


def branch_diff(commits: DataFrame, pairs: DataFrame, limit: int | None = None,
                key: Sequence[str] = DIFF_KEY) -> DataFrame:
    """Per requested (repository_id, old_branch, new_branch), the commits on
    ``old_branch`` with no commit on ``new_branch`` of equal ``key``, newest
    first (committer_time DESC, oid ASC); at most ``limit`` per pair if the caller gives one.

    Plan: old-side rows tagged with their pair(s) (where the pairs are not
    broadcast, by a salt too, as branches are few keys), ``left_anti`` against the
    new side on (repository_id, new_branch, *key) - the join key includes the
    logical key, so a huge repository spreads over all partitions - then a
    per-pair top-k."""
    key = list(key)
    salted = pairs.withColumnRenamed("old_branch", "branch").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    part = F.pmod(F.xxhash64("oid", *key), F.lit(SALTS)).cast("int")
    old = commits.withColumn("_salt", part).join(salted, ["repository_id", "branch", "_salt"]).drop("_salt")
    new = commits.select("repository_id", F.col("branch").alias("new_branch"), *key)
    missing = old.join(new, ["repository_id", "new_branch", *key], "left_anti")
    out = missing.withColumnRenamed("branch", "old_branch")
    return _top_k(out, ["repository_id", "old_branch", "new_branch"],
                  [F.col("committer_time").desc(), F.col("oid")], limit)


# --- T1/T2/T5 paging -------------------------------------------------------------

def log_page(commits: DataFrame, limit: int = 50, offset: int = 0, per_branch: bool = False) -> DataFrame:
    """ORDER BY author_time DESC LIMIT/OFFSET per repository (or per
    repository and branch); tie-break oid ASC.  ``page_rank`` is 1-based."""
    group = ["repository_id", "branch"] if per_branch else ["repository_id"]
    order = [F.col("author_time").desc(), F.col("oid")] + ([] if per_branch else [F.col("branch")])
    return _top_k(commits, group, order, limit, offset, rank_col="page_rank")


def global_log_page(commits: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """T1 single-listing form: one ordered page (TakeOrderedAndProject)."""
    return commits.orderBy(F.col("author_time").desc(), F.col("oid"), F.col("branch")).offset(offset).limit(limit)


def keyset_page(commits: DataFrame, after_time, after_oid: str, limit: int = 50,
                branch: str | None = None) -> DataFrame:
    """Next page after the last (author_time, oid) seen - no re-sort of the
    skipped rows.  Pushes a range filter into the scan."""
    df = commits if branch is None else commits.where(F.col("branch") == branch)
    t = F.lit(after_time).cast("timestamp_ntz")
    after = (F.col("author_time") < t) | ((F.col("author_time") == t) & (F.col("oid") > after_oid))
    return df.where(after).orderBy(F.col("author_time").desc(), F.col("oid")).limit(limit)


def page_flags(commits: DataFrame, limit: int = 50, offset: int = 0, faithful: bool = False) -> DataFrame:
    """T5: per (repository, branch) page: rows, has_more, next_offset.  We look
    one row past the page so an exactly full last page is not 'more';
    ``faithful=True`` reproduces rows >= limit."""
    ranked = log_page(commits, limit + 1, offset, per_branch=True)
    agg = ranked.groupBy("repository_id", "branch").agg(F.count(F.lit(1)).alias("_n"))
    rows = F.least(F.col("_n"), F.lit(limit))
    more = (rows >= limit) if faithful else (F.col("_n") > limit)
    return agg.select("repository_id", "branch", rows.alias("rows"), more.alias("has_more"),
                      F.lit(offset + limit).alias("next_offset"))


# --- W1/W2/W3 windows ---------------------------------------------------------------

def latest_commit(commits: DataFrame) -> DataFrame:
    """Newest commit per (repository_id, branch) by committer_time, oid ASC."""
    return _top_k(commits, ["repository_id", "branch"], [F.col("committer_time").desc(), F.col("oid")], 1)


def cap_per_branch(commits: DataFrame, n: int) -> DataFrame:
    """The n newest commits of every branch."""
    return _top_k(commits, ["repository_id", "branch"], [F.col("committer_time").desc(), F.col("oid")], n)


def pick_order(diff_rows: DataFrame) -> DataFrame:
    """Rows still to pick (not flagged equivalent), oldest first - the exact
    reverse of J1's order - numbered per pair."""
    todo = diff_rows.where(~F.coalesce(F.col("is_empty"), F.lit(False)))
    w = Window.partitionBy("repository_id", "old_branch", "new_branch").orderBy(F.col("committer_time"), F.col("oid").desc())
    return todo.withColumn("pick_seq", F.row_number().over(w))


# --- A1/A4/A5 counts -------------------------------------------------------------------

def commit_counts(commits: DataFrame) -> DataFrame:
    """A1: rows per repository and per (repository, branch) in one pass over two grouping sets;
    ``level`` says which.  ``distinct_commits`` counts each oid once."""
    r = commits.groupingSets([("repository_id", "branch"), ("repository_id",)], "repository_id", "branch").agg(
        F.grouping_id().alias("_g"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("oid").alias("distinct_commits"),
    )
    return r.select("repository_id", "branch",
                    F.when(F.col("_g") == 0, F.lit("branch")).otherwise(F.lit("repository")).alias("level"),
                    "n_rows", "distinct_commits")


def diff_totals(diff_rows: DataFrame) -> DataFrame:
    """A4: per pair: commits found and commits already picked (flagged)."""
    picked = F.coalesce(F.col("is_empty"), F.lit(False)) if "is_empty" in diff_rows.columns else F.lit(False)
    return diff_rows.groupBy("repository_id", "old_branch", "new_branch").agg(
        F.count(F.lit(1)).alias("found"), F.count_if(picked).alias("picked"))


def distinct_oids(df: DataFrame) -> DataFrame:
    """A5."""
    return df.select("repository_id", "oid").distinct()


# --- U1/U4 ---------------------------------------------------------------------------

def distinct_commits(commits: DataFrame) -> DataFrame:
    """One row per commit object across branches (smallest branch kept)."""
    w = Window.partitionBy("repository_id", "oid").orderBy("branch")
    return commits.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def branch_names(branches: DataFrame) -> DataFrame:
    """U4: sorted branch-name list per repository (bounded by branches per repository)."""
    return branches.groupBy("repository_id").agg(F.sort_array(F.collect_list("name")).alias("branches"))


# --- J8 / J6 / P11 ----------------------------------------------------------------------

def branch_summary(branches: DataFrame, commits: DataFrame) -> DataFrame:
    """Branch, tip sha, message first line, author, time - by joining the
    tip to the index (a merge tip is not indexed, so its fields are NULL)."""
    c = commits.select("repository_id", F.col("branch").alias("name"), F.col("oid").alias("target_oid"),
                       "message", "author_name", "committer_time")
    j = branches.join(c, ["repository_id", "name", "target_oid"], "left")
    return j.select(
        "repository_id", "name", F.col("target_oid").alias("commit_sha"), S.short_oid("target_oid").alias("sha_short"),
        F.when(F.col("committer_time").isNotNull(), S.first_line("message")).alias("commit_message"),
        F.col("author_name").alias("author"), S.rfc3339("committer_time").alias("time"),
    )


def commit_detail(commits: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """One row per commit object with identity, parents, message and
    (optionally) diff stats joined by (repository_id, oid)."""
    one = distinct_commits(commits)
    base = one.select(
        "repository_id", "oid", S.short_oid("oid").alias("sha_short"), "summary", "message",
        "author_name", "author_email", S.rfc3339("author_time").alias("author_time"),
        "committer_name", "committer_email", S.rfc3339("committer_time").alias("committer_time"),
        S.parents_to_text("parent_oids").alias("parents"), F.lit("").alias("tree"),
    )
    if stats is None:
        return base
    st = stats.withColumnRenamed("commit_oid", "oid")
    return base.join(st, ["repository_id", "oid"], "left")


# --- J4 prefix match ----------------------------------------------------------------------

def match_oid_prefix(left: DataFrame, right: DataFrame, lcol: str = "oid", rcol: str = "oid") -> DataFrame:
    """Pairs of one repository where one oid is a prefix of the other
    (either way, case aside), of any length.

    Every value names itself; a value also names its prefixes of the lengths
    that the other side has (a handful: abbreviations have few lengths, 40 at
    most).  The join is an equi-join on (repository_id, prefix), never a
    nested loop, and each pair comes out once: on the shorter value."""
    r = "repository_id"
    lo = left.withColumn("_l", F.lower(F.col(lcol)))
    ri = right.select(r, F.col(rcol).alias("matched_oid"), F.lower(F.col(rcol)).alias("_r"),
                      *[c for c in right.columns if c not in (r, rcol) and c not in left.columns])

    def prefixes(df, value, other, name):
        # the other side's lengths in the same repository
        lengths = other.select(r, F.length(name).alias("_n")).distinct()
        return df.join(lengths, r).where(F.length(value) >= F.col("_n")).withColumn("_p", F.left(F.col(value), F.col("_n"))).drop("_n")

    # the right value is the shorter one or equal; then the left value is strictly shorter
    down = prefixes(lo, "_l", ri, "_r").join(ri.withColumnRenamed("_r", "_p"), [r, "_p"]).drop("_p", "_l")
    up = (prefixes(ri, "_r", lo, "_l").where(F.length("_r") > F.length("_p"))
          .join(lo.withColumnRenamed("_l", "_p"), [r, "_p"]).drop("_p", "_r"))
    return down.unionByName(up.select(*down.columns))
