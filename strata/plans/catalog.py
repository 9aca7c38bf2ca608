"""Registered queries: one per operator of the inventory, each a function
``(spark, sf_dir) -> DataFrame`` over the driver tables, with an optional
DuckDB oracle text (``strata.plans.oracle``) returning the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.operators import queries as Q
from strata.plans.oracle import q
from strata.sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = q(oracle)
        return fn
    return deco


DIFF_COLS = ["repository_id", "old_branch", "new_branch", "oid", "author_name", "author_time",
             "committer_time", "summary"]


def _diff(spark, d, limit=None):
    commits = fx.fx_commits(spark, d)
    pairs = Q.default_branch_pairs(fx.fx_repositories(spark, d), fx.fx_branches(spark, d))
    return Q.branch_diff(commits, pairs, limit=limit)


DIFF_SQL = """
SELECT repository_id, old_branch, new_branch, oid, author_name, author_time, committer_time, summary FROM (
  SELECT c.repository_id, c.branch AS old_branch, p.new_branch, c.oid, c.author_name, c.author_time,
         c.committer_time, c.summary,
         row_number() OVER (PARTITION BY c.repository_id, c.branch, p.new_branch
                            ORDER BY c.committer_time DESC, c.oid) AS rn
  FROM fx_commits c
  JOIN fx_pairs p ON p.repository_id = c.repository_id AND p.old_branch = c.branch
  LEFT JOIN fx_commits n ON n.repository_id = c.repository_id AND n.branch = p.new_branch
                        AND n.author_time = c.author_time AND n.summary = c.summary
  WHERE n.oid IS NULL) t
"""


@register("branch_diff", oracle=DIFF_SQL)
def branch_diff(spark, d):
    """J1 flagship: every branch against its repository's default branch."""
    return _diff(spark, d).select(*DIFF_COLS)


@register("branch_diff_top", oracle=DIFF_SQL + "WHERE rn <= 25")
def branch_diff_top(spark, d):
    """J1 with the caller's limit: the newest 25 of each pair."""
    return _diff(spark, d, limit=25).select(*DIFF_COLS)


# The query modules register themselves on import.
from strata.plans import q_tables  # noqa: E402,F401
from strata.plans import q_queries  # noqa: E402,F401
from strata.plans import q_graph  # noqa: E402,F401
from strata.plans import q_diff  # noqa: E402,F401
from strata.plans import q_stream  # noqa: E402,F401
from strata.plans import q_history  # noqa: E402,F401
