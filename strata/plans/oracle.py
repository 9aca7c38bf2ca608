"""DuckDB oracle texts.

``FIXTURE_SQL`` defines the same inputs as ``strata.sources.fixtures`` as
common table expressions over the pre-registered driver tables; every oracle
query is ``FIXTURE_SQL + <select>``.  Unused CTEs cost nothing.
"""

# Fixed values shared with strata.sources.fixtures (see FIXTURES.md).
FIXTURE_SQL = r"""
WITH RECURSIVE
fx_repositories AS (
  SELECT CAST(n_nationkey AS BIGINT) + 1 AS id, lower(n_name) AS name,
         '/srv/git/r' || CAST(n_regionkey AS VARCHAR) || '/' || lower(n_name) AS path,
         CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 'mirror of ' || n_name END AS description,
         'main' AS default_branch,
         CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE TIMESTAMP '2024-02-01 00:00:00' END AS last_synced_at,
         TIMESTAMP '2024-01-01 00:00:00' AS created_at, TIMESTAMP '2024-01-01 00:00:00' AS updated_at
  FROM nation),
fx_lanes AS (
  SELECT user_id % 25 + 1 AS repository_id, event_id, user_id, event_type, props, ts,
         unnest(CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN [-1] ELSE [0, 1, 2] END) AS lane
  FROM events),
fx_nodes AS MATERIALIZED (
  SELECT repository_id, event_id, lane,
         CASE WHEN lane = -1
              THEN md5('t' || CAST(event_id AS VARCHAR)) || substr(md5('t' || CAST(event_id AS VARCHAR)), 1, 8)
              ELSE md5('b' || CAST(lane AS VARCHAR) || '-' || CAST(event_id AS VARCHAR))
                   || substr(md5('b' || CAST(lane AS VARCHAR) || '-' || CAST(event_id AS VARCHAR)), 1, 8) END AS oid,
         'user' || CAST(user_id AS VARCHAR) AS author_name,
         'user' || CAST(user_id AS VARCHAR) || '@example.com' AS author_email,
         date_trunc('second', ts) AS author_time,
         date_trunc('second', ts) + to_minutes(greatest(lane, 0)) AS committer_time,
         event_type || ' #' || CAST(event_id % 500 AS VARCHAR) AS summary,
         CASE WHEN event_id % 4 = 0 THEN '' ELSE props END AS message
  FROM fx_lanes WHERE lane = -1 OR (event_id + lane) % 3 <> 0),
fx_w AS (
  SELECT repository_id, event_id, lane, oid,
         lag(oid) OVER (PARTITION BY repository_id, lane ORDER BY event_id) AS prev_oid,
         max(CASE WHEN lane = -1 THEN event_id END) OVER (PARTITION BY repository_id) AS fork_id,
         max(CASE WHEN lane = 1 THEN event_id END) OVER (PARTITION BY repository_id ORDER BY event_id, lane
                                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rel_id
  FROM fx_nodes),
fx_commit_parents AS MATERIALIZED (
  SELECT repository_id, oid, 0 AS pos,
         coalesce(prev_oid, md5('t' || CAST(fork_id AS VARCHAR)) || substr(md5('t' || CAST(fork_id AS VARCHAR)), 1, 8)) AS parent_oid
  FROM fx_w WHERE prev_oid IS NOT NULL OR lane >= 0
  UNION ALL
  SELECT repository_id, oid, 1, md5('b1-' || CAST(rel_id AS VARCHAR)) || substr(md5('b1-' || CAST(rel_id AS VARCHAR)), 1, 8)
  FROM fx_w WHERE lane = 0 AND event_id % 20 = 0 AND rel_id IS NOT NULL),
fx_parent_text AS (
  SELECT repository_id, oid, string_agg(parent_oid, ',' ORDER BY pos) AS parents, count(*) AS n_parents
  FROM fx_commit_parents GROUP BY repository_id, oid),
fx_history AS MATERIALIZED (
  SELECT n.*, coalesce(p.parents, '') AS parents, coalesce(p.n_parents, 0) AS n_parents
  FROM fx_nodes n LEFT JOIN fx_parent_text p ON p.repository_id = n.repository_id AND p.oid = n.oid),
fx_refs AS MATERIALIZED (
  SELECT repository_id,
         CASE lane WHEN 0 THEN 'refs/remotes/origin/main' WHEN 1 THEN 'refs/remotes/origin/release'
                   ELSE 'refs/remotes/origin/dev' END AS ref_name,
         oid AS target_oid, lane = 0 AS is_head
  FROM (SELECT *, row_number() OVER (PARTITION BY repository_id, lane ORDER BY event_id DESC) AS rn
        FROM fx_nodes WHERE lane >= 0) t WHERE rn = 1),
fx_branches AS (
  SELECT repository_id, regexp_replace(ref_name, '^refs/remotes/', '') AS name, target_oid,
         is_head AS is_default, TIMESTAMP '2024-02-01 00:00:00' AS updated_at
  FROM fx_refs),
fx_commits AS MATERIALIZED (
  SELECT repository_id, oid,
         unnest(CASE lane WHEN -1 THEN ['origin/main', 'origin/release', 'origin/dev'] WHEN 0 THEN ['origin/main']
                          WHEN 1 THEN ['origin/release'] ELSE ['origin/dev'] END) AS branch,
         author_name, author_email, author_time, author_name AS committer_name, author_email AS committer_email,
         committer_time, summary, message, parents, n_parents, TIMESTAMP '2024-02-01 00:00:00' AS created_at
  FROM fx_history WHERE NOT (lane = 0 AND event_id % 20 = 0)),
fx_tree_files AS (
  SELECT md5('old' || CAST(doc_id % 25 AS VARCHAR)) AS commit_oid, doc_id % 25 + 1 AS repository_id,
         source || '/f' || CAST(doc_id AS VARCHAR) || '.txt' AS path, md5(text) AS blob_oid, text AS content
  FROM documents WHERE doc_id % 10 <> 0
  UNION ALL
  SELECT md5('new' || CAST(doc_id % 25 AS VARCHAR)), doc_id % 25 + 1, source || '/f' || CAST(doc_id AS VARCHAR) || '.txt', md5(c), c
  FROM (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN replace(replace(text, ' the ', ' THE '), ' la ', ' LA ')
                                    ELSE text END AS c
        FROM documents WHERE doc_id % 7 <> 0) x),
fx_tree_pairs AS (
  SELECT id AS pair_id, id AS repository_id, md5('old' || CAST(id - 1 AS VARCHAR)) AS from_oid,
         md5('new' || CAST(id - 1 AS VARCHAR)) AS to_oid
  FROM fx_repositories),
fx_default_branch AS (
  SELECT r.id AS repository_id, coalesce(b.branch, 'origin/main') AS default_branch
  FROM fx_repositories r LEFT JOIN (
    SELECT repository_id, arg_min(name, (NOT is_default, name)) AS branch FROM fx_branches GROUP BY repository_id) b
  ON b.repository_id = r.id),
fx_pairs AS (
  SELECT b.repository_id, b.name AS old_branch, d.default_branch AS new_branch
  FROM fx_branches b JOIN fx_default_branch d ON d.repository_id = b.repository_id
  WHERE b.name <> d.default_branch),
fx_tag_feed AS (
  SELECT repository_id, 'v' || CAST(event_id AS VARCHAR) AS name, oid AS target_oid,
         CASE WHEN event_id % 100 = 0 THEN author_name END AS tagger_name,
         CASE WHEN event_id % 100 = 0 THEN author_email END AS tagger_email,
         CASE WHEN event_id % 100 = 0 THEN CAST(epoch(author_time) AS BIGINT) END AS tagger_time,
         CASE WHEN event_id % 100 = 0 THEN 'release ' || summary END AS message
  FROM fx_nodes WHERE lane = 1 AND event_id % 50 = 0),
fx_raw_refs AS (
  SELECT * FROM fx_refs
  UNION ALL SELECT repository_id, 'refs/remotes/origin/HEAD', NULL, false FROM fx_refs WHERE ref_name = 'refs/remotes/origin/main'
  UNION ALL SELECT repository_id, 'refs/remotes/upstream/main', target_oid, false FROM fx_refs WHERE ref_name = 'refs/remotes/origin/main'),
fx_manifest AS (
  SELECT lower(r.r_name) AS name, '/srv/git/r' || CAST(r.r_regionkey AS VARCHAR) AS base_path,
         coalesce(s.paths, []) || ['.'] AS scan_paths
  FROM region r LEFT JOIN (
    SELECT n_regionkey, list(CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) || '/.' ELSE lower(n_name) END ORDER BY n_name) AS paths
    FROM nation GROUP BY n_regionkey) s ON s.n_regionkey = r.r_regionkey),
fx_inventory AS (
  SELECT '/srv/git/r' || CAST(n_regionkey AS VARCHAR) || '/' || lower(n_name) AS path FROM nation
  UNION ALL
  SELECT '/srv/git/r' || CAST(n_regionkey AS VARCHAR) || '/' || lower(n_name) || '/.git' FROM nation
  WHERE n_nationkey % 5 <> 4 AND n_nationkey % 6 <> 5
  UNION ALL
  SELECT '/srv/git/r' || CAST(n_regionkey AS VARCHAR) || '/' || lower(n_name) || '/packed-refs' FROM nation
  WHERE n_nationkey % 5 >= 3 AND n_nationkey % 6 <> 5),
fx_diff_lines AS MATERIALIZED (
  SELECT repository_id, commit_oid, path, l.seq AS seq, l.origin AS origin, l.content AS content FROM (
    SELECT repository_id, oid AS commit_oid, 'src/' || regexp_extract(summary, '^(\S+)', 1) || '.txt' AS path,
           unnest([
             {'seq': 0, 'origin': ' ', 'content': 'owner ' || author_name},
             {'seq': 1, 'origin': '-', 'content': 'count=' || CAST(event_id % 500 AS VARCHAR)},
             {'seq': 2, 'origin': '+', 'content': 'count=' || CAST(CASE WHEN lane = 1 AND event_id % 7 = 0 THEN event_id % 500 + 2
                                                                       ELSE event_id % 500 + 1 END AS VARCHAR)
                                                 || CASE WHEN lane = 2 THEN '  ' ELSE '' END},
             {'seq': 3, 'origin': '+', 'content': summary || CASE WHEN lane = 2 THEN '  ' ELSE '' END}]) AS l
    FROM fx_history WHERE n_parents <= 1) x),
fx_file_states AS (
  SELECT n.repository_id, c.chain, n.event_id, n.oid AS commit_oid,
         'src/' || regexp_extract(n.summary, '^(\S+)', 1) || '/s' || CAST(n.event_id % 9 AS VARCHAR) || '.txt' AS path,
         list_transform(['count=' || CAST(n.event_id % 500 + CASE WHEN n.lane = 1 AND n.event_id % 7 = 0 THEN 2 ELSE 1 END AS VARCHAR),
                         'note=' || n.summary, 'owner=' || n.author_name],
                        lambda x: x || CASE WHEN n.lane = 2 THEN '  ' ELSE '' END) AS lines
  FROM fx_nodes n JOIN (SELECT unnest([0, 1, 2]) AS chain) c ON n.lane = -1 OR n.lane = c.chain),
fx_commit_changes AS MATERIALIZED (
  SELECT DISTINCT repository_id, commit_oid, path, old_lines, new_lines FROM (
    SELECT repository_id, commit_oid, path, lines AS new_lines, lag(lines) OVER (PARTITION BY repository_id, chain, path ORDER BY event_id) AS old_lines
    FROM fx_file_states) x WHERE old_lines IS DISTINCT FROM new_lines
  UNION ALL
  SELECT repository_id, arg_min(oid, event_id), 'LICENSE', NULL, ['free to use'] FROM fx_nodes GROUP BY repository_id),
fx_commit_stats AS (
  SELECT repository_id, commit_oid, count(DISTINCT path) AS files_changed,
         CAST(sum(len(list_filter(range(1, len(new_lines) + 1), lambda i: old_lines[i] IS DISTINCT FROM new_lines[i]))) AS BIGINT) AS insertions,
         CAST(sum(CASE WHEN old_lines IS NULL THEN 0
                       ELSE len(list_filter(range(1, len(old_lines) + 1), lambda i: old_lines[i] IS DISTINCT FROM new_lines[i])) END) AS BIGINT) AS deletions
  FROM fx_commit_changes GROUP BY repository_id, commit_oid),
reach(repository_id, ref, oid) AS (
  SELECT repository_id, name, target_oid FROM fx_branches
  UNION
  SELECT r.repository_id, r.ref, e.parent_oid
  FROM reach r JOIN fx_commit_parents e ON e.repository_id = r.repository_id AND e.oid = r.oid)
"""


def q(body: str) -> str:
    return FIXTURE_SQL + body
