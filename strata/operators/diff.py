"""Tree and line diffs: file changes (J7/F19), line counts (D1 exact, D2
order-blind lower bound), patch lines (D3), per-commit stats (A3/F13) and
patch-equivalence fingerprints (J3).

The per-file line alignment (D1/D3) is an Arrow step over *distinct*
(old_blob, new_blob) pairs: the pairs are made distinct by id before any
content is joined, so a text travels once however many commits share it.
Everything around it - tree joins, blob lookups, aggregation - is native.

A line includes its newline, so a last line with and one without are different
lines, as in git.  Content with a NUL character is binary: no lines, 0 / 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import scalars as S

R = "repository_id"
CONTEXT = 3          # context lines around a change in patch output
BLOCK = 4096         # lines of the bit-parallel block; memory only, results are the same
NO_NEWLINE = "\x01"  # marks a last line without newline inside the comparison


# --- J7 -----------------------------------------------------------------------------

def file_changes(tree_entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per ``pairs(pair_id, repository_id, from_oid, to_oid)``, the paths
    whose blob differs between the two trees; a NULL/absent from tree is the
    empty tree.  No rename detection: a move is Deleted + Added."""
    te = tree_entries.select(R, "commit_oid", "path", "blob_oid")
    a = (te.join(pairs.select("pair_id", R, F.col("from_oid").alias("commit_oid")), [R, "commit_oid"])
         .select("pair_id", "path", F.col("blob_oid").alias("old_blob")))
    b = (te.join(pairs.select("pair_id", R, F.col("to_oid").alias("commit_oid")), [R, "commit_oid"])
         .select("pair_id", "path", F.col("blob_oid").alias("new_blob")))
    j = a.join(b, ["pair_id", "path"], "full_outer").where(~F.col("old_blob").eqNullSafe(F.col("new_blob")))
    return j.select("pair_id", "path", "old_blob", "new_blob", S.change_status("old_blob", "new_blob").alias("status"))


def first_parent_pairs(feed: DataFrame) -> DataFrame:
    """Commit vs first parent (NULL for a root commit -> empty tree)."""
    return feed.select(F.col("oid").alias("pair_id"), R, F.get("parent_oids", F.lit(0)).alias("from_oid"),
                       F.col("oid").alias("to_oid"))


def with_contents(changes: DataFrame, blobs: DataFrame) -> DataFrame:
    """Attach old and new content to file changes (missing side -> NULL)."""
    old = blobs.select(F.col("blob_oid").alias("old_blob"), F.col("content").alias("old_content"))
    new = blobs.select(F.col("blob_oid").alias("new_blob"), F.col("content").alias("new_content"))
    return changes.join(old, "old_blob", "left").join(new, "new_blob", "left")


def _binary(content) -> "F.Column":
    return F.coalesce(F.instr(content, "\x00") > 0, F.lit(False))


def _lines(content) -> "F.Column":
    """Lines of a text, the last one marked if it has no newline; NULL/'' -> none."""
    body = F.when(F.endswith(content, F.lit("\n")), F.left(content, F.length(content) - 1)).otherwise(F.concat(content, F.lit(NO_NEWLINE)))
    return F.when(F.coalesce(content, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n"))


# --- D2 -----------------------------------------------------------------------------

def line_multiset_changes(changes_with_content: DataFrame) -> DataFrame:
    """Order-blind lower bound of insertions/deletions per changed file:
    per line text, max(0, new count - old count) and the reverse.  Pure
    aggregation (partial per line), no Python."""
    keys = ["pair_id", "path"]
    texts = changes_with_content.where(~_binary(F.col("old_content")) & ~_binary(F.col("new_content")))
    old = texts.select(*keys, F.explode(_lines(F.col("old_content"))).alias("line"), F.lit(1).alias("o"), F.lit(0).alias("n"))
    new = texts.select(*keys, F.explode(_lines(F.col("new_content"))).alias("line"), F.lit(0).alias("o"), F.lit(1).alias("n"))
    per_line = old.unionByName(new).groupBy(*keys, "line").agg(F.sum("o").alias("o"), F.sum("n").alias("n"))
    per_file = per_line.groupBy(*keys).agg(
        F.sum(F.greatest(F.col("n") - F.col("o"), F.lit(0))).cast("bigint").alias("insertions"),
        F.sum(F.greatest(F.col("o") - F.col("n"), F.lit(0))).cast("bigint").alias("deletions"))
    return changes_with_content.select(*keys, "status").join(per_file, keys, "left").select(
        *keys, "status", F.coalesce("insertions", F.lit(0)).cast("bigint").alias("insertions"),
        F.coalesce("deletions", F.lit(0)).cast("bigint").alias("deletions"))


# --- per-file alignment (Python helper, Arrow batches) --------------------------------

def _split(text):
    if not text:
        return []
    return text[:-1].split("\n") if text.endswith("\n") else (text + NO_NEWLINE).split("\n")


def _trimmed(a: list, b: list) -> tuple[int, int]:
    """Lengths of the common prefix and of the common suffix of the rest."""
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return i, j


def lcs_row(a: list, b: list) -> np.ndarray:
    """Lengths of a longest common subsequence of ``a`` with every prefix of
    ``b`` (0 to all of it).  Bit-parallel over blocks of BLOCK lines of ``b``;
    one carry bit per line of ``a`` passes from block to block, so memory is
    linear in the lines."""
    carry = bytearray(len(a))
    grown = [np.zeros(1, np.int64)]
    for lo in range(0, len(b), BLOCK):
        part = b[lo: lo + BLOCK]
        masks: dict = {}
        for p, x in enumerate(part):
            masks[x] = masks.get(x, 0) | (1 << p)
        width = len(part)
        full = (1 << width) - 1
        v = full
        for y, line in enumerate(a):
            u = v & masks.get(line, 0)
            s = v + u + carry[y]
            carry[y] = s >> width
            v = ((s & full) | (v & ~u)) & full
        zeros = np.unpackbits(np.frombuffer(v.to_bytes((width + 7) // 8, "little"), np.uint8), bitorder="little")[:width] == 0
        grown.append(zeros)
    return np.cumsum(np.concatenate(grown))


def _common(a: np.ndarray, b: np.ndarray, x: int, y: int, step: int = 16) -> int:
    """Equal items of a[x:] and b[y:] from their beginnings on."""
    n, most = 0, min(len(a) - x, len(b) - y)
    while n < most:
        size = min(step, most - n)
        differ = a[x + n: x + n + size] != b[y + n: y + n + size]
        first = int(differ.argmax())
        if differ[first]:
            return n + first
        n, step = n + size, step * 4
    return most


def middle_snake(a: np.ndarray, b: np.ndarray, budget: int | None = None) -> tuple[int, int, int, int, int] | None:
    """(D, x, y, u, v): the length D of a shortest edit script and a run of equal
    items from (x, y) to (u, v) halfway along one, by the greedy O(ND) search
    from both ends in linear space (Myers 1986).  None once more than ``budget``
    furthest points were visited: the edit distance is then large."""
    n, m = len(a), len(b)
    delta, odd = n - m, (n - m) % 2 == 1
    ra, rb = a[::-1], b[::-1]
    front, back, used = {1: 0}, {1: 0}, 0
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            if k < -m or k > n:
                continue
            x = front.get(k + 1, 0) if k == -d or (k != d and front.get(k - 1, -1) < front.get(k + 1, -1)) else front[k - 1] + 1
            x0, y0 = x, x - k
            if x0 > n or y0 > m or y0 < 0:
                front[k] = x
                continue
            x += _common(a, b, x0, y0)
            front[k] = x
            if odd and -(d - 1) <= delta - k <= d - 1 and delta - k in back and x + back[delta - k] >= n:
                return 2 * d - 1, x0, y0, x, x - k
        for k in range(-d, d + 1, 2):
            if k < -m or k > n:
                continue
            x = back.get(k + 1, 0) if k == -d or (k != d and back.get(k - 1, -1) < back.get(k + 1, -1)) else back[k - 1] + 1
            x0, y0 = x, x - k
            if x0 > n or y0 > m or y0 < 0:
                back[k] = x
                continue
            x += _common(ra, rb, x0, y0)
            back[k] = x
            if not odd and -d <= delta - k <= d and delta - k in front and x + front[delta - k] >= n:
                return 2 * d, n - x, m - (x - k), n - x0, m - y0
        used += 2 * (d + 1)
        if budget is not None and used > budget:
            return None
    raise AssertionError("an edit script exists")


def _budget(n: int, m: int) -> int:
    """Furthest points up to which the greedy search costs no more than the bit-parallel rows, about two a line and block."""
    return 2 * n * -(-m // BLOCK) + 64


def _numbered(a: list, b: list) -> tuple[np.ndarray, np.ndarray]:
    """Both line lists as numbers, equal lines as equal ones."""
    code: dict = {}
    return (np.array([code.setdefault(x, len(code)) for x in a], np.int64), np.array([code.setdefault(x, len(code)) for x in b], np.int64))


def lcs_length(a: list, b: list) -> int:
    """Length of a longest common subsequence of two line lists, of any length:
    by the greedy search while the edit distance is small, which it finds out,
    else by bit-parallel rows."""
    i, j = _trimmed(a, b)
    a2, b2 = a[i:len(a) - j], b[i:len(b) - j]
    shared = set(a2) & set(b2)  # other lines cannot match
    a2, b2 = [x for x in a2 if x in shared], [x for x in b2 if x in shared]
    if not a2 or not b2:
        return i + j
    found = middle_snake(*_numbered(a2, b2), budget=_budget(len(a2), len(b2)))
    return i + j + ((len(a2) + len(b2) - found[0]) // 2 if found else int(lcs_row(a2, b2)[-1]))


def align(a: list, b: list) -> list:
    """Minimal edit script as (origin, text) with origin ' ', '-', '+': exact in
    linear space for any length.  The problem is cut in two at the middle of a
    shortest script where the edit distance is small, else by halving ``a`` and
    cutting ``b`` where the subsequences of the halves are longest together
    (the first such place)."""
    out: list = []
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if a is None:  # a common tail put off until its middle is out
            out += [(" ", t) for t in b]
            continue
        i, j = _trimmed(a, b)
        out += [(" ", t) for t in a[:i]]
        if j:
            todo.append((None, a[len(a) - j:]))
        a, b = a[i:len(a) - j], b[i:len(b) - j]
        if not a or not b:
            out += [("-", t) for t in a] + [("+", t) for t in b]
        elif len(a) == 1:
            k = b.index(a[0]) if a[0] in b else -1
            out += [("-", a[0])] + [("+", t) for t in b] if k < 0 else [("+", t) for t in b[:k]] + [(" ", a[0])] + [("+", t) for t in b[k + 1:]]
        else:
            found = middle_snake(*_numbered(a, b), budget=_budget(len(a), len(b)))
            if found and found[0] == len(a) + len(b):  # nothing in common
                out += [("-", t) for t in a] + [("+", t) for t in b]
            elif found:
                _, x, y, u, v = found
                todo += [(a[u:], b[v:]), (None, a[x:u]), (a[:x], b[:y])]
            else:
                half = len(a) // 2
                k = int(np.argmax(lcs_row(a[:half], b) + lcs_row(a[half:][::-1], b[::-1])[::-1]))
                todo += [(a[half:], b[k:]), (a[:half], b[:k])]
    return out


def _is_binary(text) -> bool:
    return text is not None and "\x00" in text


def _count_batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        ins, dels = [], []
        for o, n in zip(pdf["old_content"], pdf["new_content"]):
            a, b = ([], []) if _is_binary(o) or _is_binary(n) else (_split(o), _split(n))
            lcs = lcs_length(a, b)
            ins.append(len(b) - lcs); dels.append(len(a) - lcs)
        yield pd.DataFrame({"old_blob": pdf["old_blob"], "new_blob": pdf["new_blob"], "insertions": ins, "deletions": dels})


def patch_rows(old: str | None, new: str | None) -> list[tuple]:
    """(seq, origin, content, ordinal, old_line, new_line, no_newline) of one file:
    changed lines with CONTEXT lines around them; ordinal numbers the changed
    ones; a line's numbers on the sides that have it, from 1."""
    if _is_binary(old) or _is_binary(new):
        return []
    script = align(_split(old), _split(new))
    change = np.flatnonzero(np.fromiter((o != " " for o, _ in script), bool, len(script)))
    keep = np.unique(np.clip((change[:, None] + np.arange(-CONTEXT, CONTEXT + 1)).ravel(), 0, max(len(script) - 1, 0)))
    in_old = np.cumsum(np.fromiter((o != "+" for o, _ in script), np.int64, len(script)))
    in_new = np.cumsum(np.fromiter((o != "-" for o, _ in script), np.int64, len(script)))
    rows, ordinal = [], 0
    for seq, k in enumerate(keep.tolist()):
        origin, text = script[k]
        ordinal += origin != " "
        rows.append((seq, origin, text.removesuffix(NO_NEWLINE), ordinal if origin != " " else None, int(in_old[k]) if origin != "+" else None,
                     int(in_new[k]) if origin != "-" else None, text.endswith(NO_NEWLINE)))
    return rows


PATCH = ["seq", "origin", "content", "ordinal", "old_line", "new_line", "no_newline"]
PATCH_SCHEMA = "seq int, origin string, content string, ordinal int, old_line int, new_line int, no_newline boolean"


def _patch_batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        rows = [(ob, nb, *r) for ob, nb, o, n in zip(pdf["old_blob"], pdf["new_blob"], pdf["old_content"], pdf["new_content"]) for r in patch_rows(o, n)]
        if rows:  # an empty frame has no column types
            out = pd.DataFrame(rows, columns=["old_blob", "new_blob", *PATCH])
            yield out.astype({"old_blob": "string", "new_blob": "string", "seq": "int32", "ordinal": "Int32", "origin": "string", "content": "string", "old_line": "Int32", "new_line": "Int32"})


def _per_blob_pair(changes: DataFrame, blobs: DataFrame, fn, schema: str, how: str) -> DataFrame:
    """Run ``fn`` once per distinct (old_blob, new_blob), joined back to ``changes``.
    The ids are made distinct first; contents join the few distinct pairs."""
    pairs = with_contents(changes.select("old_blob", "new_blob").distinct(), blobs)
    # few rows a batch, as a row holds two whole texts
    found = pairs.select("old_blob", "new_blob", "old_content", "new_content").mapInPandas(fn, f"old_blob string, new_blob string, {schema}")
    same = F.col("c.old_blob").eqNullSafe(F.col("x.old_blob")) & F.col("c.new_blob").eqNullSafe(F.col("x.new_blob"))
    return changes.alias("c").join(found.alias("x"), same, how)


def line_change_counts(changes: DataFrame, blobs: DataFrame) -> DataFrame:
    """Exact insertions/deletions per changed file (n - LCS), for files of any size."""
    return _per_blob_pair(changes, blobs, _count_batches, "insertions bigint, deletions bigint", "left").select(
        "c.pair_id", "c.path", "c.status", "x.insertions", "x.deletions")


def diff_lines(changes: DataFrame, blobs: DataFrame) -> DataFrame:
    """D3: patch lines (pair_id, path, seq, origin, content, ordinal, old_line,
    new_line, no_newline) with 3 context lines; ordinal numbers the changed
    lines of a file, no_newline marks a last line without one."""
    return _per_blob_pair(changes, blobs, _patch_batches, PATCH_SCHEMA, "inner").select("c.pair_id", "c.path", *[f"x.{c}" for c in PATCH])


def patched(files: DataFrame, patch: DataFrame, key: list[str], reverse: bool = False) -> DataFrame:
    """The other side of patched files: ``files(*key, content)`` with the patch lines
    of D3 applied (taken back if ``reverse``), as (*key, content).

    A file's lines are numbered; those the patch takes away go, those it adds
    have their numbers on the other side, and the rest keep their order in the
    numbers left free.  Files without patch lines come out as they are."""
    gone, come, here, there = ("+", "-", "new_line", "old_line") if reverse else ("-", "+", "old_line", "new_line")
    lines = files.where(~_binary(F.col("content"))).select(*key, F.posexplode(_lines(F.col("content"))).alias("_at", "_line"))
    lines = lines.select(*key, (F.col("_at") + 1).alias(here), F.replace("_line", F.lit(NO_NEWLINE), F.lit("")).alias("_text"),
                         F.endswith("_line", F.lit(NO_NEWLINE)).alias("_open"))
    away = patch.where(F.col("origin") == gone).select(*key, here)
    stay = lines.join(away, [*key, here], "left_anti")
    stay = stay.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(here)))
    added = patch.where(F.col("origin") == come).select(*key, F.col(there).alias("_no"), F.col("content").alias("_text"), F.col("no_newline").alias("_open"))
    # the k-th line that stays gets the k-th free number: k plus the added lines at or before it
    before = added.select(*key, "_no", (F.col("_no") - F.row_number().over(Window.partitionBy(*key).orderBy("_no"))).alias("_free"))  # free numbers below each added one
    shift = before.groupBy(*key, "_free").agg(F.count(F.lit(1)).alias("_n"))
    shift = shift.select(*key, (F.col("_free") + 1).alias("_k"), F.col("_n"))
    moved = stay.select(*key, "_k", "_text", "_open", F.lit(0).cast("bigint").alias("_n"), F.lit(1).alias("_is")).unionByName(
        shift.select(*key, "_k", F.lit(None).cast("string").alias("_text"), F.lit(None).cast("boolean").alias("_open"), "_n", F.lit(0).alias("_is")))
    upto = Window.partitionBy(*key).orderBy("_k", "_is").rowsBetween(Window.unboundedPreceding, 0)
    placed = moved.select(*key, (F.col("_k") + F.sum("_n").over(upto)).alias("_no"), "_text", "_open", "_is").where("_is = 1").drop("_is")
    every = placed.unionByName(added.select(*key, F.col("_no").cast("bigint").alias("_no"), "_text", "_open"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_no", "_text", "_open"))),
                                    lambda r: F.concat(r["_text"], F.when(r["_open"], F.lit("")).otherwise(F.lit("\n")))), "")
    built = every.groupBy(*key).agg(text.alias("_built"))  # one file's lines
    out = files.select(*key, F.col("content").alias("_content")).join(built, key, "left")
    same = F.when(_binary(F.col("_content")), F.col("_content")).otherwise(F.lit(""))
    return out.select(*key, F.coalesce("_built", same).alias("content"))


def commit_patch_lines(feed: DataFrame, tree_entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """D3 of every commit against its first parent (the empty tree for a root),
    as (repository_id, commit_oid, path, seq, origin, content, ordinal): the
    input of J3, F12 and P11.  Commits without a stored tree give no lines."""
    stored = tree_entries.select(R, F.col("commit_oid").alias("to_oid")).distinct()
    pairs = first_parent_pairs(feed).join(stored, [R, "to_oid"], "left_semi")
    pairs = pairs.withColumn("pair_id", F.concat_ws("/", F.col(R).cast("string"), F.col("to_oid")))
    lines = diff_lines(file_changes(tree_entries, pairs), blobs).drop("old_line", "new_line", "no_newline")
    return lines.join(pairs.select("pair_id", R, F.col("to_oid").alias("commit_oid")), "pair_id").drop("pair_id")


# --- A3 -----------------------------------------------------------------------------------

def diff_stats(file_counts: DataFrame) -> DataFrame:
    """Files changed, insertions, deletions per pair, plus the text line."""
    agg = file_counts.groupBy("pair_id").agg(
        F.count_distinct("path").alias("files_changed"),
        F.sum("insertions").cast("bigint").alias("insertions"),
        F.sum("deletions").cast("bigint").alias("deletions"))
    return agg.select("*", S.format_diff_stats("files_changed", "insertions", "deletions").alias("diff_stats"))


# --- J3 -----------------------------------------------------------------------------------

def patch_fingerprints(lines: DataFrame) -> DataFrame:
    """Per commit: sum of xxhash64(path, k, origin, whitespace-free content)
    over its changed lines (k = ordinal among the file's changed lines), the
    changed-line count and the changed-path count.  Associative, so it is a
    partial aggregate; no patch text is collected."""
    changed = lines.where(F.col("origin").isin("+", "-"))
    # D3 numbers the changed lines; lines from elsewhere are numbered here
    w = Window.partitionBy(R, "commit_oid", "path").orderBy("seq")
    k = F.col("ordinal") if "ordinal" in lines.columns else F.row_number().over(w)
    h = F.xxhash64(F.col("path"), k, F.col("origin"), F.regexp_replace("content", r"\s+", ""))
    per = changed.select(R, "commit_oid", "path", h.cast("decimal(38,0)").alias("h"))
    return per.groupBy(R, "commit_oid").agg(
        F.sum("h").alias("fp_sum"), F.count(F.lit(1)).alias("n_lines"), F.count_distinct("path").alias("n_paths"))


def pair_fingerprints(changes: DataFrame, blobs: DataFrame) -> DataFrame:
    """Per distinct (old_blob, new_blob): fp_sum and n_lines of its patch, each
    patch aligned and hashed once however many commits share it.  Line numbers
    and context lines do not count, white space inside lines neither."""
    lines = _per_blob_pair(changes.select("old_blob", "new_blob").distinct(), blobs, _patch_batches, PATCH_SCHEMA, "inner").where(F.col("x.origin") != " ")
    h = F.xxhash64("x.ordinal", "x.origin", F.regexp_replace("x.content", r"\s+", "")).cast("decimal(38,0)")
    return lines.groupBy("c.old_blob", "c.new_blob").agg(F.sum(h).alias("fp_sum"), F.count(F.lit(1)).alias("n_lines"))


def commit_fingerprints(changes: DataFrame, blobs: DataFrame) -> DataFrame:
    """J3's key per commit from its file changes (repository_id, commit_oid, path,
    old_blob, new_blob): the sum over its files of the hash of path and patch
    fingerprint, with line and path counts.  Partial aggregates only."""
    fps = pair_fingerprints(changes, blobs)
    same = F.col("c.old_blob").eqNullSafe(F.col("f.old_blob")) & F.col("c.new_blob").eqNullSafe(F.col("f.new_blob"))
    each = changes.alias("c").join(fps.alias("f"), same).select(
        f"c.{R}", "c.commit_oid", "f.n_lines", F.xxhash64("c.path", "f.fp_sum", "f.n_lines").cast("decimal(38,0)").alias("h"))
    return each.groupBy(R, "commit_oid").agg(F.sum("h").alias("fp_sum"), F.sum("n_lines").alias("n_lines"), F.count(F.lit(1)).alias("n_paths"))


def commit_diff_stats(changes: DataFrame, blobs: DataFrame) -> DataFrame:
    """F13/P11 per commit: files changed, insertions and deletions by D1 over distinct blob pairs."""
    counted = _per_blob_pair(changes, blobs, _count_batches, "insertions bigint, deletions bigint", "left")
    return counted.groupBy(f"c.{R}", "c.commit_oid").agg(
        F.count_distinct("c.path").alias("files_changed"), F.sum("x.insertions").cast("bigint").alias("insertions"), F.sum("x.deletions").cast("bigint").alias("deletions"))


def flag_equivalent_sets(only_old: DataFrame, only_new: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """J3 over the two sides of the symmetric difference, each
    (repository_id, old_ref, new_ref, oid) - e.g. from frontier intervals."""
    fp = fingerprints.withColumnRenamed("commit_oid", "oid")
    k = [R, "old_ref", "new_ref"]
    left = only_old.join(fp, [R, "oid"])
    right = only_new.join(fp, [R, "oid"]).select(*k, "fp_sum", "n_lines", "n_paths")
    return left.join(right, [*k, "fp_sum", "n_lines", "n_paths"], "left_semi").select(*k, "oid")
