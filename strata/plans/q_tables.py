"""Registered queries: scans, sources, projections, upserts (S*, P*, K*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions import scalars as S
from strata.operators import queries as Q
from strata.operators import tables as T
from strata.plans.catalog import register
from strata.sources import fixtures as fx

NOW = "2024-03-01 00:00:00"
SPLIT = "2024-01-25 00:00:00"      # index state of the previous cycle: commits before this
OVERLAP = "2024-01-20 00:00:00"    # incoming batch starts here, overlapping the index

COMMIT_COLS = ["repository_id", "oid", "branch", "author_name", "author_email", "author_time", "committer_name",
               "committer_email", "committer_time", "summary", "message", "created_at"]


def _ts(x):
    return F.lit(x).cast("timestamp_ntz")


@register("repositories_scan", oracle="SELECT * FROM fx_repositories")
def repositories_scan(spark, d):
    """Repositories ordered by name."""
    return fx.fx_repositories(spark, d).orderBy("name", "path")


@register("commits_scan", oracle="SELECT " + ", ".join(COMMIT_COLS) + ", parents FROM fx_commits")
def commits_scan(spark, d):
    """S2 + F9: the index with parents as comma-joined text."""
    return fx.fx_commits(spark, d).select(*COMMIT_COLS, S.parents_to_text("parent_oids").alias("parents"))


@register("branches_scan", oracle="SELECT * FROM fx_branches")
def branches_scan(spark, d):
    """Branch rows from the ref feed, default first then by name."""
    return T.branch_order(fx.fx_branches(spark, d))


@register("tags", oracle="""
SELECT repository_id, name, target_oid, tagger_name, tagger_email, to_timestamp(tagger_time)::TIMESTAMP AS tagger_time,
       message, tagger_name IS NOT NULL OR message IS NOT NULL AS annotated, TIMESTAMP '2024-03-01 00:00:00' AS created_at
FROM fx_tag_feed""")
def tags(spark, d):
    """Annotated and lightweight tags."""
    return T.tags_from_feed(fx.fx_tag_feed(spark, d), NOW)


@register("commit_feed", oracle="""
SELECT repository_id, oid, author_name, author_email, CAST(epoch(author_time) AS BIGINT) AS author_time,
       author_name AS committer_name, author_email AS committer_email, CAST(epoch(committer_time) AS BIGINT) AS committer_time,
       summary, message, parents FROM fx_history""")
def commit_feed(spark, d):
    """The commit feed (epoch seconds), parents as text."""
    f = fx.fx_commit_feed(spark, d)
    return f.select(*[c for c in f.columns if c != "parent_oids"], S.parents_to_text("parent_oids").alias("parents"))


@register("ref_feed_branches", oracle="""
SELECT repository_id, regexp_replace(ref_name, '^refs/remotes/', '') AS name, target_oid, coalesce(is_head, false) AS is_default,
       TIMESTAMP '2024-03-01 00:00:00' AS updated_at,
       starts_with(regexp_replace(ref_name, '^refs/remotes/', ''), 'origin/') AS indexed
FROM fx_raw_refs WHERE ref_name IS NOT NULL AND ref_name <> '' AND target_oid IS NOT NULL""")
def ref_feed_branches(spark, d):
    """Valid refs become branch rows; only origin/* are indexed."""
    b = T.refs_to_branches(fx.fx_raw_refs(spark, d), NOW)
    return b.withColumn("indexed", F.col("name").startswith(S.ORIGIN_PREFIX))


@register("rejected_refs", oracle="""
SELECT *, CASE WHEN ref_name IS NULL OR ref_name = '' THEN 'no_name' ELSE 'no_target' END AS reason
FROM fx_raw_refs WHERE ref_name IS NULL OR ref_name = '' OR target_oid IS NULL""")
def rejected_refs(spark, d):
    """P6 side table: symbolic / unnamed refs with the reason."""
    return T.rejected_refs(fx.fx_raw_refs(spark, d))


@register("tree_entries_scan", oracle="SELECT repository_id, commit_oid, path, blob_oid FROM fx_tree_files")
def tree_entries_scan(spark, d):
    """Tree entries."""
    return fx.fx_tree_entries(spark, d)


@register("expand_manifest", oracle=r"""
SELECT project, scan_pos, name, path FROM (
  SELECT project, scan_pos, path, regexp_extract(path, '([^/]*)$', 1) AS name FROM (
    SELECT project, scan_pos,
           regexp_replace(regexp_replace(regexp_replace(base_path, '/+$', '') || '/' || regexp_replace(scan_path, '^/+', ''),
                                         '(/\.)+(/|$)', '/', 'g'), '(.)/+$', '\1') AS path
    FROM (SELECT name AS project, base_path, unnest(range(len(scan_paths))) AS scan_pos, unnest(scan_paths) AS scan_path
          FROM fx_manifest) m) c
  WHERE path IN (SELECT regexp_replace(path, '/(\.git|packed-refs)$', '') FROM fx_inventory
                 WHERE regexp_matches(path, '/(\.git|packed-refs)$'))) t""")
def expand_manifest(spark, d):
    """Manifest x scan paths -> existing repositories."""
    return T.expand_manifest(fx.fx_manifest(spark, d), fx.fx_inventory(spark, d))


def _split_commits(spark, d):
    c = fx.fx_commits(spark, d)
    existing = c.where(F.col("committer_time") < _ts(SPLIT))
    batch = c.where(F.col("committer_time") >= _ts(OVERLAP))
    return existing, batch


@register("insert_new_commits", oracle=f"""
SELECT repository_id, oid, branch, committer_time, summary FROM fx_commits
WHERE committer_time >= TIMESTAMP '{SPLIT}'""")
def insert_new_commits(spark, d):
    """K1: a batch overlapping the index and holding every row twice inserts each new key once."""
    existing, batch = _split_commits(spark, d)
    ins = T.insert_new_commits(existing, batch.unionByName(batch))
    return ins.select("repository_id", "oid", "branch", "committer_time", "summary")


@register("upsert_commits", oracle=f"""
SELECT repository_id, oid, branch, author_name, author_time, committer_time,
       CASE WHEN committer_time >= TIMESTAMP '{OVERLAP}' THEN upper(summary) ELSE summary END AS summary,
       CASE WHEN committer_time >= TIMESTAMP '{OVERLAP}' THEN 'edited' ELSE message END AS message,
       CASE WHEN committer_time >= TIMESTAMP '{SPLIT}' THEN TIMESTAMP '{NOW}' ELSE created_at END AS created_at
FROM fx_commits""")
def upsert_commits(spark, d):
    """K2: matched keys change only summary and message; new keys are inserted whole.
    Every key comes twice; the later row by created_at counts."""
    existing, batch = _split_commits(spark, d)
    inc = batch.select(*[F.upper("summary").alias("summary") if c == "summary" else
                         F.lit("edited").alias("message") if c == "message" else
                         _ts(NOW).alias("created_at") if c == "created_at" else F.col(c) for c in batch.columns])
    stale = inc.withColumn("summary", F.lit("zz stale")).withColumn("created_at", _ts(NOW) - F.expr("INTERVAL 1 HOUR"))
    out = T.upsert_commits(existing, inc.unionByName(stale))
    return out.select("repository_id", "oid", "branch", "author_name", "author_time", "committer_time",
                      "summary", "message", "created_at")


@register("upsert_branches", oracle=f"""
SELECT repository_id, name, target_oid,
       CASE WHEN name = 'origin/release' THEN true ELSE is_default END AS is_default,
       CASE WHEN name = 'origin/release' THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at
FROM fx_branches
UNION ALL
SELECT repository_id, 'origin/hotfix', target_oid, false, TIMESTAMP '{NOW}' FROM fx_branches WHERE name = 'origin/release'""")
def upsert_branches(spark, d):
    """K3: release becomes default, a hotfix branch appears; every key comes twice, the later row counts."""
    b = fx.fx_branches(spark, d)
    rel = b.where(F.col("name") == "origin/release")
    inc = rel.select("repository_id", "name", "target_oid", F.lit(True).alias("is_default"), _ts(NOW).alias("updated_at")) \
        .unionByName(rel.select("repository_id", F.lit("origin/hotfix").alias("name"), "target_oid",
                                F.lit(False).alias("is_default"), _ts(NOW).alias("updated_at")))
    stale = inc.withColumn("target_oid", F.lit("f" * 40)).withColumn("updated_at", _ts(NOW) - F.expr("INTERVAL 1 HOUR"))
    return T.upsert_branches(b, stale.unionByName(inc))


@register("upsert_repositories", oracle=f"""
SELECT id, name, path, CASE WHEN name >= 'f' THEN 'synced ' || name ELSE description END AS description, default_branch,
       CASE WHEN name >= 'f' THEN TIMESTAMP '{NOW}' ELSE last_synced_at END AS last_synced_at,
       created_at, CASE WHEN name >= 'f' THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at
FROM fx_repositories WHERE name < 'p'
UNION ALL
SELECT id + 100, name, path, 'synced ' || name, default_branch, TIMESTAMP '{NOW}', TIMESTAMP '{NOW}', TIMESTAMP '{NOW}'
FROM fx_repositories WHERE name >= 'p'""")
def upsert_repositories(spark, d):
    """K4: keyed by path; existing rows keep id and created_at; every path comes twice, the later row counts."""
    r = fx.fx_repositories(spark, d)
    existing = r.where(F.col("name") < "p")
    inc = r.where(F.col("name") >= "f").select(
        (F.col("id") + 100).alias("id"), "name", "path", F.concat(F.lit("synced "), F.col("name")).alias("description"),
        "default_branch", _ts(NOW).alias("last_synced_at"))
    stale = inc.withColumn("description", F.lit("stale")).withColumn("last_synced_at", _ts(NOW) - F.expr("INTERVAL 1 HOUR"))
    return T.upsert_repositories(existing, inc.unionByName(stale), NOW)


@register("touch_sync_time", oracle=f"""
SELECT id, name, path, description, default_branch,
       CASE WHEN description IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE last_synced_at END AS last_synced_at, created_at,
       CASE WHEN description IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at
FROM fx_repositories""")
def touch_sync_time(spark, d):
    """K5: synced repositories get last_synced_at = updated_at = now."""
    r = fx.fx_repositories(spark, d)
    return T.touch_sync_time(r, r.where(F.col("description").isNotNull()).select("id"), NOW)


def _deleted_ids(spark, d):
    return fx.fx_repositories(spark, d).where(F.col("path").startswith("/srv/git/r0/")).select("id")


_KEPT = "repository_id NOT IN (SELECT id FROM fx_repositories WHERE path LIKE '/srv/git/r0/%') GROUP BY repository_id"


@register("delete_repositories", oracle=f"""
SELECT 'repositories' AS tbl, id AS repository_id, count(*) AS n FROM fx_repositories WHERE path NOT LIKE '/srv/git/r0/%' GROUP BY id
UNION ALL SELECT 'commits', repository_id, count(*) FROM fx_commits WHERE {_KEPT}
UNION ALL SELECT 'branches', repository_id, count(*) FROM fx_branches WHERE {_KEPT}
UNION ALL SELECT 'tags', repository_id, count(*) FROM fx_tag_feed WHERE {_KEPT}""")
def delete_repositories(spark, d):
    """K6: deleting the repositories of one region cascades to their commits, branches and tags."""
    tables = {"repositories": fx.fx_repositories(spark, d), "commits": fx.fx_commits(spark, d),
              "branches": fx.fx_branches(spark, d), "tags": T.tags_from_feed(fx.fx_tag_feed(spark, d), NOW)}
    out = T.delete_repositories(tables, _deleted_ids(spark, d))
    parts = [df.groupBy(F.col("id" if name == "repositories" else "repository_id").alias("repository_id"))
             .agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "repository_id", "n") for name, df in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@register("delete_branches_by_repository", oracle="""
SELECT * FROM fx_branches WHERE repository_id NOT IN (SELECT id FROM fx_repositories WHERE path LIKE '/srv/git/r0/%')""")
def delete_branches_by_repository(spark, d):
    """K7."""
    return T.delete_by_repository(fx.fx_branches(spark, d), _deleted_ids(spark, d))


def _rfc(c):
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%S') || '+00:00'"


@register("export_commits", oracle=f"""
SELECT repository_id, oid, branch, author_name, author_email, {_rfc('author_time')} AS author_time, committer_name,
       committer_email, {_rfc('committer_time')} AS committer_time, summary, message, {_rfc('created_at')} AS created_at
FROM fx_commits""")
def export_commits(spark, d):
    """Commit DTO rows (no parents), RFC 3339 times."""
    return T.export_commits(fx.fx_commits(spark, d))


@register("export_repositories", oracle=f"""
SELECT id, name, path, description, default_branch, {_rfc('last_synced_at')} AS last_synced_at,
       {_rfc('created_at')} AS created_at, {_rfc('updated_at')} AS updated_at FROM fx_repositories""")
def export_repositories(spark, d):
    """K8: repository DTO rows."""
    return T.export_repositories(fx.fx_repositories(spark, d))


@register("export_json_lines", oracle=f"""
SELECT CAST(to_json(struct_pack(id := id, name := name, path := path, description := description, default_branch := default_branch,
       last_synced_at := {_rfc('last_synced_at')}, created_at := {_rfc('created_at')}, updated_at := {_rfc('updated_at')})) AS VARCHAR) AS json
FROM fx_repositories""")
def export_json_lines(spark, d):
    """K8: one JSON document per repository row, absent values as null."""
    return T.to_json_lines(T.export_repositories(fx.fx_repositories(spark, d)))


@register("find_repositories", oracle="SELECT * FROM fx_repositories WHERE path LIKE '/srv/git/r1/%'")
def find_repositories(spark, d):
    """Lookup of many names at once (semi-join)."""
    r = fx.fx_repositories(spark, d)
    keys = r.where(F.col("path").startswith("/srv/git/r1/")).select("name")
    return T.find_repositories(r, keys, "name")


@register("find_repositories_by_id", oracle="SELECT * FROM fx_repositories WHERE path LIKE '/srv/git/r2/%'")
def find_repositories_by_id(spark, d):
    """Lookup by id."""
    r = fx.fx_repositories(spark, d)
    return T.find_repositories(r, r.where(F.col("path").startswith("/srv/git/r2/")).select("id"), "id")


@register("find_repositories_by_path", oracle="SELECT * FROM fx_repositories WHERE name >= 'm'")
def find_repositories_by_path(spark, d):
    """Lookup by path."""
    r = fx.fx_repositories(spark, d)
    return T.find_repositories(r, r.where(F.col("name") >= "m").select("path"), "path")


@register("repositories_exist", oracle="""
SELECT path, path IN (SELECT path FROM fx_repositories) AS present FROM (
  SELECT path FROM fx_repositories UNION ALL SELECT path || '-gone' FROM fx_repositories) t""")
def repositories_exist(spark, d):
    """Which of the asked paths are known."""
    r = fx.fx_repositories(spark, d)
    asked = r.select("path").union(r.select(F.concat(F.col("path"), F.lit("-gone")).alias("path")))
    return T.repositories_exist(r, asked, "path")


@register("find_commit_by_oid", oracle="""
SELECT repository_id, oid, min(branch) AS branch FROM fx_commits
WHERE (repository_id, oid) IN (SELECT repository_id, target_oid FROM fx_refs) GROUP BY repository_id, oid""")
def find_commit_by_oid(spark, d):
    """One index row per requested (repository, oid), smallest branch."""
    keys = fx.fx_refs(spark, d).select("repository_id", F.col("target_oid").alias("oid"))
    return T.find_commits_by_oid(fx.fx_commits(spark, d), keys).select("repository_id", "oid", "branch")


@register("repository_listing", oracle=f"""
SELECT id, name, path, coalesce(description, 'N/A') AS description, {_rfc('coalesce(last_synced_at, created_at)')} AS last_modified
FROM fx_repositories""")
def repository_listing(spark, d):
    """P8."""
    return T.repository_listing(fx.fx_repositories(spark, d))


@register("default_branch", oracle="SELECT * FROM fx_default_branch")
def default_branch(spark, d):
    """P13."""
    return T.default_branch(fx.fx_repositories(spark, d), fx.fx_branches(spark, d))


@register("oid_validity", oracle=r"""
SELECT kind, count(*) AS n, count(*) FILTER (WHERE length(cand) = 40 AND regexp_full_match(cand, '[0-9a-fA-F]{40}')) AS valid
FROM (SELECT unnest(['oid', 'upper', 'short', 'long', 'newline', 'nonhex']) AS kind,
             unnest([oid, upper(oid), substr(oid, 1, 39), oid || '0', oid || chr(10), 'g' || substr(oid, 2)]) AS cand
      FROM fx_nodes) t GROUP BY kind""")
def oid_validity(spark, d):
    """P12/F10 over oids and malformed variants (39/41 chars, upper case, newline, non-hex)."""
    n = fx.fx_nodes(spark, d)
    kinds = F.array(*[F.lit(k) for k in ["oid", "upper", "short", "long", "newline", "nonhex"]])
    cands = F.array(F.col("oid"), F.upper("oid"), F.substring("oid", 1, 39), F.concat("oid", F.lit("0")),
                    F.concat("oid", F.lit("\n")), F.concat(F.lit("g"), F.substring("oid", 2, 100)))
    z = n.select(F.explode(F.arrays_zip(kinds.alias("kind"), cands.alias("cand"))).alias("z")).select("z.kind", "z.cand")
    return z.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(S.is_valid_oid("cand")).alias("valid"))


@register("drop_merges", oracle="SELECT repository_id, oid FROM fx_history WHERE n_parents <= 1")
def drop_merges(spark, d):
    """P5: merge commits are not indexed."""
    return T.drop_merges(fx.fx_commit_feed(spark, d)).select("repository_id", "oid")


@register("branch_summary", oracle=f"""
SELECT b.repository_id, b.name, b.target_oid AS commit_sha, substr(b.target_oid, 1, 8) AS sha_short,
       CASE WHEN c.committer_time IS NOT NULL THEN coalesce(regexp_replace(split_part(c.message, chr(10), 1), chr(13) || '$', ''), '') END AS commit_message,
       c.author_name AS author, {_rfc('c.committer_time')} AS time
FROM fx_branches b LEFT JOIN fx_commits c ON c.repository_id = b.repository_id AND c.branch = b.name AND c.oid = b.target_oid""")
def branch_summary(spark, d):
    """Branch tips with message, author and time (merge tips are not indexed -> NULL)."""
    return Q.branch_summary(fx.fx_branches(spark, d), fx.fx_commits(spark, d))


@register("branch_names", oracle="""
SELECT repository_id, string_agg(name, ',' ORDER BY name) AS branches FROM fx_branches GROUP BY repository_id""")
def branch_names(spark, d):
    """U4: sorted branch names per repository."""
    return Q.branch_names(fx.fx_branches(spark, d)).select("repository_id", F.array_join("branches", ",").alias("branches"))
