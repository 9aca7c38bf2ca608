"""Registered queries: paging, top-k, windows, counts, scalar functions
(T*, W1/W2, A1, U1, P7, P11, F*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions import scalars as S
from strata.operators import diff as D
from strata.operators import queries as Q
from strata.operators import tables as T
from strata.plans.catalog import register
from strata.plans.q_graph import history_changes
from strata.sources import fixtures as fx

NOW = "2024-02-01 12:00:00"
FIRST_LINE_SQL = "coalesce(regexp_replace(split_part({m}, chr(10), 1), chr(13) || '$', ''), '')"
RFC_SQL = "strftime({t}, '%Y-%m-%dT%H:%M:%S') || '+00:00'"

P7_SQL = (f"repository_id, branch, oid AS sha, substr(oid, 1, 8) AS sha_short, {FIRST_LINE_SQL.format(m='message')} AS message, "
          f"summary, author_name, author_email, {RFC_SQL.format(t='committer_time')} AS committer_time, false AS is_empty")


@register("log_page_branch", oracle=f"""
SELECT {P7_SQL}, page_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY repository_id, branch ORDER BY author_time DESC, oid) AS page_rank FROM fx_commits) t
WHERE page_rank <= 50""")
def log_page_branch(spark, d):
    """T1 + P7: first UI page (50 rows) of every branch of every repository."""
    page = Q.log_page(fx.fx_commits(spark, d), limit=50, offset=0, per_branch=True)
    return T.log_rows(page, "page_rank")


@register("log_page_default_branch", oracle=f"""
SELECT {P7_SQL}, page_rank FROM (
  SELECT c.*, row_number() OVER (PARTITION BY c.repository_id ORDER BY c.author_time DESC, c.oid) AS page_rank
  FROM fx_commits c JOIN fx_default_branch b ON b.repository_id = c.repository_id AND b.default_branch = c.branch) t
WHERE page_rank <= 50""")
def log_page_default_branch(spark, d):
    """P13 + T1 + P7: the log a repository opens with, the first page of its default branch."""
    chosen = T.default_branch(fx.fx_repositories(spark, d), fx.fx_branches(spark, d))
    rows = fx.fx_commits(spark, d).join(chosen.withColumnRenamed("default_branch", "branch"), ["repository_id", "branch"], "left_semi")
    return T.log_rows(Q.log_page(rows, limit=50, offset=0, per_branch=True), "page_rank")


@register("log_page_repository", oracle="""
SELECT repository_id, branch, oid, author_time, page_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY author_time DESC, oid, branch) AS page_rank FROM fx_commits) t
WHERE page_rank > 100 AND page_rank <= 200""")
def log_page_repository(spark, d):
    """API page (100 rows) at offset 100 of every repository, all branches."""
    page = Q.log_page(fx.fx_commits(spark, d), limit=100, offset=100, per_branch=False)
    return page.select("repository_id", "branch", "oid", "author_time", "page_rank")


@register("global_log_page", oracle="""
SELECT repository_id, branch, oid, author_time FROM fx_commits ORDER BY author_time DESC, oid, branch LIMIT 100 OFFSET 50""")
def global_log_page(spark, d):
    """T1 single-listing form (TakeOrderedAndProject with offset)."""
    return Q.global_log_page(fx.fx_commits(spark, d), limit=100, offset=50).select(
        "repository_id", "branch", "oid", "author_time")


@register("keyset_page", oracle="""
SELECT repository_id, branch, oid, author_time FROM fx_commits
WHERE branch = 'origin/main' AND author_time < TIMESTAMP '2024-01-20 00:00:00'
ORDER BY author_time DESC, oid LIMIT 100""")
def keyset_page(spark, d):
    """The page after a (time, oid) position, without re-sorting skipped rows."""
    return Q.keyset_page(fx.fx_commits(spark, d), "2024-01-20 00:00:00", "", limit=100, branch="origin/main").select(
        "repository_id", "branch", "oid", "author_time")


@register("page_flags", oracle="""
SELECT b.repository_id, b.name AS branch, least(coalesce(x.n, 0), 50) AS rows, coalesce(x.n, 0) > 50 AS has_more,
       350 AS next_offset
FROM fx_branches b LEFT JOIN (
  SELECT repository_id, branch, count(*) AS n FROM (
    SELECT repository_id, branch, row_number() OVER (PARTITION BY repository_id, branch ORDER BY author_time DESC, oid) AS rn
    FROM fx_commits) t WHERE rn > 300 AND rn <= 351 GROUP BY repository_id, branch) x
ON x.repository_id = b.repository_id AND x.branch = b.name""")
def page_flags(spark, d):
    """T5: rows, has_more and next_offset of page offset=300, limit=50 for every branch."""
    flags = Q.page_flags(fx.fx_commits(spark, d), limit=50, offset=300)
    b = fx.fx_branches(spark, d).select("repository_id", F.col("name").alias("branch"))
    j = b.join(flags, ["repository_id", "branch"], "left")
    return j.select("repository_id", "branch", F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"),
                    F.coalesce("has_more", F.lit(False)).alias("has_more"), F.lit(350).alias("next_offset"))


@register("latest_commit", oracle="""
SELECT repository_id, branch, oid, committer_time FROM (
  SELECT *, row_number() OVER (PARTITION BY repository_id, branch ORDER BY committer_time DESC, oid) AS rn FROM fx_commits) t
WHERE rn = 1""")
def latest_commit(spark, d):
    """Newest indexed commit of every branch."""
    return Q.latest_commit(fx.fx_commits(spark, d)).select("repository_id", "branch", "oid", "committer_time")


@register("cap_per_branch", oracle="""
SELECT repository_id, branch, oid, committer_time FROM (
  SELECT *, row_number() OVER (PARTITION BY repository_id, branch ORDER BY committer_time DESC, oid) AS rn FROM fx_commits) t
WHERE rn <= 100""")
def cap_per_branch(spark, d):
    """The 100 newest commits of every branch."""
    return Q.cap_per_branch(fx.fx_commits(spark, d), 100).select("repository_id", "branch", "oid", "committer_time")


@register("commit_counts", oracle="""
SELECT repository_id, branch, CASE WHEN grouping(branch) = 0 THEN 'branch' ELSE 'repository' END AS level,
       count(*) AS n_rows, count(DISTINCT oid) AS distinct_commits
FROM fx_commits GROUP BY ROLLUP (repository_id, branch) HAVING grouping(repository_id) = 0""")
def commit_counts(spark, d):
    """A1: counts per repository and per branch in one rollup."""
    return Q.commit_counts(fx.fx_commits(spark, d))


@register("distinct_commits", oracle="SELECT repository_id, oid, min(branch) AS branch FROM fx_commits GROUP BY repository_id, oid")
def distinct_commits(spark, d):
    """Each commit object once across branches."""
    return Q.distinct_commits(fx.fx_commits(spark, d)).select("repository_id", "oid", "branch")


@register("branch_diff_by_oid", oracle="""
SELECT repository_id, old_branch, new_branch, oid, committer_time FROM (
  SELECT c.repository_id, c.branch AS old_branch, p.new_branch, c.oid, c.committer_time,
         row_number() OVER (PARTITION BY c.repository_id, c.branch, p.new_branch ORDER BY c.committer_time DESC, c.oid) AS rn
  FROM fx_commits c JOIN fx_pairs p ON p.repository_id = c.repository_id AND p.old_branch = c.branch
  WHERE NOT EXISTS (SELECT 1 FROM fx_commits n WHERE n.repository_id = c.repository_id AND n.branch = p.new_branch
                    AND n.oid = c.oid)) t""")
def branch_diff_by_oid(spark, d):
    """J1 with the key as a parameter: commits identity (oid) instead of (author_time, summary)."""
    commits = fx.fx_commits(spark, d)
    pairs = Q.default_branch_pairs(fx.fx_repositories(spark, d), fx.fx_branches(spark, d))
    return Q.branch_diff(commits, pairs, key=("oid",)).select(
        "repository_id", "old_branch", "new_branch", "oid", "committer_time")


@register("commit_detail", oracle=f"""
SELECT c.repository_id, c.oid, substr(c.oid, 1, 8) AS sha_short, c.summary, c.message, c.author_name, c.author_email,
       {RFC_SQL.format(t='c.author_time')} AS author_time, c.committer_name, c.committer_email,
       {RFC_SQL.format(t='c.committer_time')} AS committer_time, c.parents, '' AS tree,
       s.files_changed, s.insertions, s.deletions,
       CAST(s.files_changed AS VARCHAR) || ' files changed, ' || CAST(s.insertions AS VARCHAR) || ' insertions(+), '
         || CAST(s.deletions AS VARCHAR) || ' deletions(-)' AS diff_stats
FROM (SELECT DISTINCT repository_id, oid, summary, message, author_name, author_email, author_time, committer_name,
             committer_email, committer_time, parents FROM fx_commits) c
LEFT JOIN fx_commit_stats s
  ON s.repository_id = c.repository_id AND s.commit_oid = c.oid""")
def commit_detail(spark, d):
    """Commit identity, parents and the stats of its diff against the first parent."""
    st = D.commit_diff_stats(history_changes(spark, d), fx.fx_history_blobs(spark, d))
    st = st.withColumn("diff_stats", S.format_diff_stats("files_changed", "insertions", "deletions"))
    return Q.commit_detail(fx.fx_commits(spark, d), st)


@register("message_functions", oracle=r"""
SELECT conv_id, turn,
       coalesce(regexp_replace(split_part(text, chr(10), 1), chr(13) || '$', ''), '') AS first_line,
       regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '^\s+', ''),
                      '\n[ \t\r]*\n[\s\S]*$', ''), '\s*\n\s*', ' ', 'g'), '^\s+|\s+$', '', 'g') AS summary,
       nullif(regexp_replace(regexp_extract(regexp_replace(coalesce(text, ''), '^\s+', ''), '\n[ \t\r]*\n([\s\S]*)$', 1),
                             '^\s+|\s+$', '', 'g'), '') AS body,
       substr(text, 1, 8) AS short
FROM conversations""")
def message_functions(spark, d):
    """F1, F2, F18 over multi-line texts."""
    m = fx.fx_messages(spark, d)
    return m.select("conv_id", "turn", S.first_line("message").alias("first_line"), S.summary_of("message").alias("summary"),
                    S.body_of("message").alias("body"), S.short_oid("message").alias("short"))


@register("ref_functions", oracle="""
SELECT repository_id, ref_name, regexp_replace(ref_name, '^refs/(remotes/origin|heads)/', '') AS short_ref,
       regexp_replace(regexp_replace(ref_name, '^refs/remotes/', ''), '^origin/', '') AS stripped,
       'refs/remotes/' || regexp_replace(ref_name, '^refs/remotes/', '') AS full_ref,
       CASE WHEN starts_with(regexp_replace(ref_name, '^refs/(remotes/origin|heads)/', ''), 'origin/')
            THEN regexp_replace(ref_name, '^refs/(remotes/origin|heads)/', '')
            ELSE 'origin/' || regexp_replace(ref_name, '^refs/(remotes/origin|heads)/', '') END AS with_origin
FROM fx_raw_refs""")
def ref_functions(spark, d):
    """F5-F8 over the listed refs."""
    r = fx.fx_raw_refs(spark, d)
    name = F.regexp_replace("ref_name", "^refs/remotes/", "")
    return r.select("repository_id", "ref_name", S.short_ref("ref_name").alias("short_ref"),
                    S.strip_origin(name).alias("stripped"), S.full_ref(name).alias("full_ref"),
                    S.ensure_origin(S.short_ref("ref_name")).alias("with_origin"))


def _ago_sql(t):
    s = f"(CAST(epoch(TIMESTAMP '{NOW}') AS BIGINT) - CAST(epoch({t}) AS BIGINT))"
    parts = [f"WHEN {s} > {size} THEN CAST({s} // {size} AS VARCHAR) || ' {label} ago'" for size, label in S.TIME_AGO_UNITS]
    return "CASE " + " ".join(parts) + f" ELSE CAST({s} AS VARCHAR) || ' seconds ago' END"


def _rel_sql(t):
    s = f"(CAST(epoch(TIMESTAMP '{NOW}') AS BIGINT) - CAST(epoch({t}) AS BIGINT))"
    m, h, dd = f"({s} // 60)", f"({s} // 3600)", f"({s} // 86400)"

    def unit(n, w):
        return f"CAST({n} AS VARCHAR) || ' {w}' || CASE WHEN {n} > 1 THEN 's' ELSE '' END || ' ago'"
    return (f"CASE WHEN {dd} > 7 THEN strftime({t}, '%Y-%m-%d') WHEN {dd} > 0 THEN {unit(dd, 'day')} "
            f"WHEN {h} > 0 THEN {unit(h, 'hour')} WHEN {m} > 0 THEN {unit(m, 'min')} ELSE 'Just now' END")


@register("time_functions", oracle=f"""
SELECT repository_id, oid, {RFC_SQL.format(t='committer_time')} AS committer_rfc3339,
       CAST(epoch(author_time) AS BIGINT) AS author_epoch, to_timestamp(CAST(epoch(author_time) AS BIGINT))::TIMESTAMP AS author_ts,
       {_ago_sql('committer_time')} AS time_ago, {_rel_sql('committer_time')} AS relative_date
FROM fx_nodes""")
def time_functions(spark, d):
    """F3, F4, F14, F15 against a fixed 'now'."""
    n = fx.fx_nodes(spark, d)
    now = F.lit(NOW).cast("timestamp_ntz")
    return n.select("repository_id", "oid", S.rfc3339("committer_time").alias("committer_rfc3339"),
                    S.ts_to_epoch("author_time").alias("author_epoch"),
                    S.epoch_to_ts(S.ts_to_epoch("author_time")).alias("author_ts"),
                    S.time_ago("committer_time", now).alias("time_ago"),
                    S.relative_date("committer_time", now).alias("relative_date"))


@register("diff_line_html", oracle="""
SELECT repository_id, commit_oid, path, seq,
       CASE origin WHEN '+' THEN '<span class="diff-add-line">' || e || '</span>'
                   WHEN '-' THEN '<span class="diff-remove-line">' || e || '</span>'
                   WHEN ' ' THEN '<span class="diff-context"> ' || e || '</span>' ELSE e END AS html
FROM (SELECT *, replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS e FROM fx_diff_lines) t""")
def diff_line_html(spark, d):
    """F11/F12 over patch lines."""
    dl = fx.fx_diff_lines(spark, d)
    return dl.select("repository_id", "commit_oid", "path", "seq", S.diff_line_html("origin", "content").alias("html"))


@register("lossy_utf8", oracle="SELECT doc_id, length(text) AS n_chars, text FROM documents")
def lossy_utf8(spark, d):
    """bytes decoded with invalid sequences replaced (valid text passes unchanged)."""
    docs = fx.table(spark, d, "documents")
    clean = S.lossy_utf8(F.col("text").cast("binary"))
    return docs.select("doc_id", F.length(clean).alias("n_chars"), clean.alias("text"))


@register("parents_roundtrip", oracle="""
SELECT repository_id, oid, parents, n_parents AS n FROM fx_history""")
def parents_roundtrip(spark, d):
    """array -> text -> array keeps the parents ('' for a root)."""
    h = fx.fx_history(spark, d)
    txt = S.parents_to_text("parent_oids")
    return h.select("repository_id", "oid", txt.alias("parents"), F.size(S.parents_from_text(txt)).cast("bigint").alias("n"))
