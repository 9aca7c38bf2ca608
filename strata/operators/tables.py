"""Table-level operators: projections and filters over the stored tables
(P1-P13), feed normalisation (S4, S8, P9, P10) and upserts/deletes as pure
functions ``(existing, incoming) -> new state`` (K1-K8).

Plain Parquet has no MERGE/DELETE, so every write operator returns the next
version of a table; the caller writes it to a new location (or overwrites the
touched partitions from a staged copy), never onto the path being read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import scalars as S

COMMIT_KEY = ["repository_id", "oid", "branch"]
BRANCH_KEY = ["repository_id", "name"]


# --- feeds -> rows -------------------------------------------------------------

def valid_refs(ref_feed: DataFrame) -> DataFrame:
    """Refs with a name and a direct target (symbolic/unreadable ones skipped)."""
    return ref_feed.where(F.col("ref_name").isNotNull() & (F.col("ref_name") != "") & F.col("target_oid").isNotNull())


def rejected_refs(ref_feed: DataFrame) -> DataFrame:
    """P6 side table: the refs ``valid_refs`` skips, with a reason."""
    reason = (F.when(F.col("ref_name").isNull() | (F.col("ref_name") == ""), F.lit("no_name"))
              .when(F.col("target_oid").isNull(), F.lit("no_target")))
    return ref_feed.select("*", reason.alias("reason")).where(F.col("reason").isNotNull())


def refs_to_branches(ref_feed: DataFrame, updated_at) -> DataFrame:
    """Remote-tracking ref -> branch row named like ``origin/main``;
    is_default compares normalised names (feed's is_head)."""
    refs = valid_refs(ref_feed)
    return refs.select(
        "repository_id",
        F.regexp_replace("ref_name", "^refs/remotes/", "").alias("name"),
        "target_oid",
        F.coalesce(F.col("is_head"), F.lit(False)).alias("is_default"),
        (updated_at if isinstance(updated_at, Column) else F.lit(updated_at).cast("timestamp_ntz")).alias("updated_at"),
    )


def remote_branches(branches: DataFrame) -> DataFrame:
    """Only ``origin/*`` branches are indexed."""
    return branches.where(F.col("name").startswith(S.ORIGIN_PREFIX))


def drop_merges(df: DataFrame) -> DataFrame:
    """P5: merge commits (more than one parent) are not indexed."""
    return df.where(F.coalesce(F.size("parent_oids"), F.lit(0)) <= 1)


def feed_to_commits(feed: DataFrame, created_at) -> DataFrame:
    """P10: feed rows tagged with ``branch`` -> index rows (times as TIMESTAMP_NTZ,
    missing message -> '')."""
    return feed.select(
        "repository_id", "oid", "branch", "author_name", "author_email",
        S.epoch_to_ts("author_time").alias("author_time"),
        "committer_name", "committer_email",
        S.epoch_to_ts("committer_time").alias("committer_time"),
        "summary", F.coalesce(F.col("message"), F.lit("")).alias("message"), "parent_oids",
        (created_at if isinstance(created_at, Column) else F.lit(created_at).cast("timestamp_ntz")).alias("created_at"),
    )


def tags_from_feed(tag_feed: DataFrame, created_at) -> DataFrame:
    """Tag rows; annotated when tagger or message is present."""
    return tag_feed.where(F.col("name").isNotNull() & F.col("target_oid").isNotNull()).select(
        "repository_id", "name", "target_oid", "tagger_name", "tagger_email",
        S.epoch_to_ts("tagger_time").alias("tagger_time"), "message",
        (F.col("tagger_name").isNotNull() | F.col("message").isNotNull()).alias("annotated"),
        F.lit(created_at).cast("timestamp_ntz").alias("created_at"),
    )


def expand_manifest(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """Project x scan path -> repositories that exist and hold ``.git`` or
    ``packed-refs`` (no recursion).  ``inventory(path)`` lists existing paths."""
    cand = manifest.select(
        F.col("name").alias("project"),
        F.posexplode("scan_paths").alias("scan_pos", "scan_path"),
        "base_path",
    ).select("project", "scan_pos", normalise_path(S.path_join("base_path", "scan_path")).alias("path"))
    marker = r"/(\.git|packed-refs)$"
    git_dirs = (inventory.where(F.col("path").rlike(marker))
                .select(F.regexp_replace("path", marker, "").alias("path")))
    found = cand.join(git_dirs, "path", "left_semi")
    return found.select("project", "scan_pos", S.path_basename("path").alias("name"), "path")


def normalise_path(p) -> Column:
    """Drop '.' components and trailing '/' (a lexical stand-in for canonicalize)."""
    x = F.regexp_replace(p, r"(/\.)+(/|$)", "/")
    return F.regexp_replace(x, r"(.)/+$", "$1")


# --- lookups and projections ---------------------------------------------------

def find_repositories(repositories: DataFrame, keys: DataFrame, on: str = "name") -> DataFrame:
    """Repositories whose ``on`` column matches any key row (semi-join)."""
    return repositories.join(keys.select(on), on, "left_semi")


def repositories_exist(repositories: DataFrame, keys: DataFrame, on: str = "path") -> DataFrame:
    """Every asked key and whether a repository has it."""
    asked = keys.select(on).distinct()
    known = repositories.select(F.col(on).alias("_known")).distinct()
    return asked.join(known, F.col(on) == F.col("_known"), "left").select(on, F.col("_known").isNotNull().alias("present"))


def find_commits_by_oid(commits: DataFrame, keys: DataFrame) -> DataFrame:
    """One index row per requested (repository_id, oid): the smallest branch."""
    hit = commits.join(keys.select("repository_id", "oid"), ["repository_id", "oid"], "left_semi")
    w = Window.partitionBy("repository_id", "oid").orderBy("branch")
    return hit.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def filter_branch(commits: DataFrame, branch: str | None) -> DataFrame:
    """Optional branch filter."""
    return commits if branch is None else commits.where(F.col("branch") == branch)


def valid_oids(df: DataFrame, col: str = "oid") -> DataFrame:
    """P12."""
    return df.where(S.is_valid_oid(col))


def log_rows(commits: DataFrame, *keep: str) -> DataFrame:
    """Rows of a log page; ``keep`` names further columns to carry."""
    return commits.select(
        "repository_id", "branch",
        F.col("oid").alias("sha"), S.short_oid("oid").alias("sha_short"),
        S.first_line("message").alias("message"), "summary", "author_name", "author_email",
        S.rfc3339("committer_time").alias("committer_time"), F.lit(False).alias("is_empty"), *keep,
    )


def repository_listing(repositories: DataFrame) -> DataFrame:
    """Name, path, description (else 'N/A'), last_modified."""
    return repositories.select(
        "id", "name", "path",
        F.coalesce(F.col("description"), F.lit("N/A")).alias("description"),
        S.rfc3339(F.coalesce("last_synced_at", "created_at")).alias("last_modified"),
    )


def default_branch(repositories: DataFrame, branches: DataFrame) -> DataFrame:
    """Per repository the first default branch by name, else the first
    branch by name, else 'origin/main'.  A partial aggregate, not a window."""
    best = branches.groupBy("repository_id").agg(
        F.min(F.struct((~F.col("is_default")).alias("nd"), F.col("name"))).getField("name").alias("branch"))
    return (repositories.select(F.col("id").alias("repository_id"))
            .join(best, "repository_id", "left")
            .select("repository_id", F.coalesce("branch", F.lit(S.FALLBACK_BRANCH)).alias("default_branch")))


def branch_order(branches: DataFrame) -> DataFrame:
    """T4: is_default DESC, name ASC."""
    return branches.orderBy(F.col("repository_id"), F.col("is_default").desc(), F.col("name"))


# --- upserts and deletes (pure functions) ----------------------------------------

def insert_new_commits(existing: DataFrame, incoming: DataFrame, order_by: Sequence[str] = ("committer_time", "oid")) -> DataFrame:
    """K1: rows of ``incoming`` whose key (repository_id, oid, branch) is not in
    ``existing``; duplicate keys inside the batch keep their first row by
    ``order_by``.  The new table is ``existing.unionByName(result)``; the
    number inserted is ``result.count()``.  Running it twice inserts nothing."""
    return first_of_keys(incoming, order_by).join(existing.select(*COMMIT_KEY), COMMIT_KEY, "left_anti")


def first_of_keys(incoming: DataFrame, order_by: Sequence[str] = ("committer_time", "oid")) -> DataFrame:
    """K1 inside a batch: the first row of every key by ``order_by``."""
    # equal keys with equal order are told apart by every other column, so the choice is total
    ties = [c for c in incoming.columns if c not in COMMIT_KEY and c not in order_by]
    w = Window.partitionBy(*COMMIT_KEY).orderBy(*order_by, *ties)
    return incoming.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], update_cols: Sequence[str],
           defaults: dict | None = None, order_by: Sequence[str] | None = None) -> DataFrame:
    """K2-K4: partial-column merge.  Matched rows take ``update_cols`` from
    ``incoming`` and keep every other column; new keys are inserted
    (``defaults`` fills columns incoming lacks); untouched rows pass through.
    Of several incoming rows of one key the last by ``order_by`` counts
    (ties by all its columns), so keys stay unique.  One full-outer join, so
    each side is shuffled once; the choice of the last row is a partial
    aggregate."""
    defaults = defaults or {}
    rest = [c for c in incoming.columns if c not in keys and c not in (order_by or ())]
    last = F.max(F.struct(*(order_by or ()), *rest)).alias("_last")
    incoming = incoming.groupBy(*keys).agg(last).select(*keys, "_last.*").select(*incoming.columns)
    cols = existing.columns
    e = existing.select(*[F.col(c).alias(f"_e_{c}") for c in cols], F.lit(True).alias("_e"))
    inc_cols = set(incoming.columns)
    i = incoming.select(*[F.col(c).alias(f"_i_{c}") for c in incoming.columns], F.lit(True).alias("_i"))
    cond = None
    for k in keys:
        c = F.col(f"_e_{k}") == F.col(f"_i_{k}")
        cond = c if cond is None else cond & c
    j = e.join(i, cond, "full_outer")
    out = []
    for c in cols:
        if c in keys:
            out.append(F.coalesce(F.col(f"_e_{c}"), F.col(f"_i_{c}")).alias(c))
            continue
        new_val = F.col(f"_i_{c}") if c in inc_cols else defaults.get(c, F.lit(None)).cast(existing.schema[c].dataType)
        if c in update_cols:
            out.append(F.when(F.col("_i").isNotNull(), new_val).otherwise(F.col(f"_e_{c}")).alias(c))
        else:
            out.append(F.when(F.col("_e").isNotNull(), F.col(f"_e_{c}")).otherwise(new_val).alias(c))
    return j.select(*out)


def upsert_commits(existing: DataFrame, incoming: DataFrame, order_by: Sequence[str] = ("created_at",)) -> DataFrame:
    """K2: on conflict only summary and message change; the last incoming row of a key by ``order_by`` wins."""
    return upsert(existing, incoming, COMMIT_KEY, ["summary", "message"], order_by=order_by)


def upsert_branches(existing: DataFrame, incoming: DataFrame, order_by: Sequence[str] = ("updated_at",)) -> DataFrame:
    """K3: on conflict target_oid, is_default, updated_at change; the last incoming row of a key by ``order_by`` wins."""
    return upsert(existing, incoming, BRANCH_KEY, ["target_oid", "is_default", "updated_at"], order_by=order_by)


def upsert_repositories(existing: DataFrame, incoming: DataFrame, now, order_by: Sequence[str] = ("last_synced_at",)) -> DataFrame:
    """K4: keyed by path; id and created_at kept; a new path gets
    id = xxhash64(path) and created_at = now; the last incoming row of a path
    by ``order_by`` wins."""
    now_c = F.lit(now).cast("timestamp_ntz")
    inc = incoming
    if "id" not in inc.columns:
        inc = inc.withColumn("id", F.xxhash64("path"))
    if "created_at" not in inc.columns:
        inc = inc.withColumn("created_at", now_c)
    inc = inc.withColumn("updated_at", now_c)
    return upsert(existing, inc, ["path"],
                  ["name", "description", "default_branch", "last_synced_at", "updated_at"], order_by=order_by)


def touch_sync_time(repositories: DataFrame, synced_ids: DataFrame, now) -> DataFrame:
    """K5: last_synced_at = updated_at = now for the synced ids."""
    hit = synced_ids.select(F.col("id").alias("_sid")).distinct()
    j = repositories.join(hit, repositories["id"] == hit["_sid"], "left")
    now_c = F.lit(now).cast("timestamp_ntz")
    out = []
    for c in repositories.columns:
        if c in ("last_synced_at", "updated_at"):
            out.append(F.when(F.col("_sid").isNotNull(), now_c).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def delete_by_repository(table: DataFrame, ids: DataFrame, col: str = "repository_id") -> DataFrame:
    """K7 (and K6 per child table): rows whose repository is not deleted."""
    return table.join(ids.select(F.col("id").alias(col)), col, "left_anti")


def delete_repositories(tables: dict, ids: DataFrame) -> dict:
    """K6: cascade over repositories (by id) and every child table (by repository_id)."""
    out = {}
    for name, df in tables.items():
        out[name] = delete_by_repository(df, ids, "id" if name == "repositories" else "repository_id")
    return out


def export_repositories(repositories: DataFrame) -> DataFrame:
    """K8: repository DTO rows, timestamps as RFC 3339; ``to_json`` gives the document."""
    return repositories.select(
        "id", "name", "path", "description", "default_branch",
        S.rfc3339("last_synced_at").alias("last_synced_at"),
        S.rfc3339("created_at").alias("created_at"), S.rfc3339("updated_at").alias("updated_at"),
    )


def export_commits(commits: DataFrame) -> DataFrame:
    """K8: commit DTO rows (no parent_oids), timestamps as RFC 3339."""
    return commits.select(
        "repository_id", "oid", "branch", "author_name", "author_email", S.rfc3339("author_time").alias("author_time"),
        "committer_name", "committer_email", S.rfc3339("committer_time").alias("committer_time"),
        "summary", "message", S.rfc3339("created_at").alias("created_at"),
    )


def to_json_lines(df: DataFrame) -> DataFrame:
    """K8: one JSON document per row, absent values as null."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
