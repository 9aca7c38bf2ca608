"""Column functions (F1-F19).  All are built-in expressions, so they stay in
whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must match the original tool's output -----------------
# Prefixes of remote-tracking and local branch refs.
REMOTE_PREFIX = "refs/remotes/origin/"
HEADS_PREFIX = "refs/heads/"
REMOTES_PREFIX = "refs/remotes/"
ORIGIN_PREFIX = "origin/"
# Fallback branch name when a repository has no branch rows.
FALLBACK_BRANCH = "origin/main"
# Diff line HTML classes for added, removed and context lines.
HTML_ADD = '<span class="diff-add-line">'
HTML_DEL = '<span class="diff-remove-line">'
HTML_CTX = '<span class="diff-context"> '
HTML_END = "</span>"
# "time ago" thresholds in seconds: year, month, day, hour, minute.
TIME_AGO_UNITS = [(31536000, "years"), (2592000, "months"), (86400, "days"), (3600, "hours"), (60, "minutes")]
# -----------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def short_oid(oid) -> Column:
    """first 8 characters."""
    return F.substring(_c(oid), 1, 8)


def first_line(message) -> Column:
    """first line of a message, CR of a CRLF ending dropped; NULL -> ''."""
    head = F.split(_c(message), "\n", 2).getItem(0)
    return F.coalesce(F.regexp_replace(head, "\r$", ""), F.lit(""))


def rfc3339(ts) -> Column:
    """UTC timestamp as RFC 3339 text with an explicit +00:00 offset."""
    return F.concat(F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def epoch_to_ts(seconds) -> Column:
    """epoch seconds -> TIMESTAMP_NTZ (UTC wall clock)."""
    return F.timestamp_seconds(_c(seconds)).cast("timestamp_ntz")


def ts_to_epoch(ts) -> Column:
    """TIMESTAMP_NTZ (UTC wall clock) -> epoch seconds."""
    return F.unix_seconds(_c(ts).cast("timestamp"))


def short_ref(name) -> Column:
    """strip refs/remotes/origin/, else refs/heads/ (once, anchored)."""
    return F.regexp_replace(_c(name), r"^refs/(remotes/origin|heads)/", "")


def strip_origin(name) -> Column:
    """F6."""
    return F.regexp_replace(_c(name), r"^origin/", "")


def full_ref(name) -> Column:
    """refs/remotes/ + name."""
    return F.concat(F.lit(REMOTES_PREFIX), _c(name))


def ensure_origin(name) -> Column:
    """F8."""
    n = _c(name)
    return F.when(n.startswith(ORIGIN_PREFIX), n).otherwise(F.concat(F.lit(ORIGIN_PREFIX), n))


def parents_to_text(parents) -> Column:
    """parent array -> comma-joined text ('' for a root commit)."""
    return F.array_join(_c(parents), ",")


def parents_from_text(text) -> Column:
    """comma-joined text -> array; '' gives an empty array."""
    return F.filter(F.split(_c(text), ","), lambda x: x != F.lit(""))


def is_valid_oid(oid) -> Column:
    """exactly 40 hex digits, either case."""
    o = _c(oid)
    return F.coalesce((F.length(o) == 40) & o.rlike("^[0-9a-fA-F]{40}$"), F.lit(False))


def escape_html(text) -> Column:
    """& then < then >."""
    t = F.replace(_c(text), F.lit("&"), F.lit("&amp;"))
    t = F.replace(t, F.lit("<"), F.lit("&lt;"))
    return F.replace(t, F.lit(">"), F.lit("&gt;"))


def diff_line_html(origin, content) -> Column:
    """one patch line as HTML; sign dropped, context keeps a leading space."""
    o, esc = _c(origin), escape_html(content)
    return (
        F.when(o == "+", F.concat(F.lit(HTML_ADD), esc, F.lit(HTML_END)))
        .when(o == "-", F.concat(F.lit(HTML_DEL), esc, F.lit(HTML_END)))
        .when(o == " ", F.concat(F.lit(HTML_CTX), esc, F.lit(HTML_END)))
        .otherwise(esc)
    )


def format_diff_stats(files, insertions, deletions) -> Column:
    """never singular."""
    return F.format_string("%d files changed, %d insertions(+), %d deletions(-)",
                           _c(files), _c(insertions), _c(deletions))


def time_ago(ts, now) -> Column:
    """largest unit whose ratio is strictly above 1, else seconds."""
    secs = ts_to_epoch(now) - ts_to_epoch(ts)
    expr = None
    for size, label in TIME_AGO_UNITS:
        cond = secs > size  # ratio > 1  <=>  seconds > unit
        val = F.concat(F.floor(secs / size).cast("string"), F.lit(f" {label} ago"))
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr.otherwise(F.concat(secs.cast("string"), F.lit(" seconds ago")))


def relative_date(ts, now) -> Column:
    """> 7 days -> ISO date; else days/hours/mins ago; else 'Just now'."""
    secs = ts_to_epoch(now) - ts_to_epoch(ts)
    mins = F.floor(secs / 60)
    hours = F.floor(mins / 60)
    days = F.floor(hours / 24)

    def unit(n, word):
        return F.concat(n.cast("string"), F.lit(" " + word), F.when(n > 1, F.lit("s")).otherwise(F.lit("")), F.lit(" ago"))

    return (
        F.when(days > 7, F.date_format(_c(ts), "yyyy-MM-dd"))
        .when(days > 0, unit(days, "day"))
        .when(hours > 0, unit(hours, "hour"))
        .when(mins > 0, unit(mins, "min"))
        .otherwise(F.lit("Just now"))
    )


def path_join(base, rel) -> Column:
    """Join a base path and a relative scan path with one '/'."""
    return F.concat(F.regexp_replace(_c(base), "/+$", ""), F.lit("/"), F.regexp_replace(_c(rel), "^/+", ""))


def path_basename(path) -> Column:
    """F16: last path component ('.' components and trailing '/' ignored), else 'unknown'."""
    trimmed = F.regexp_replace(_c(path), r"(/\.?)+$", "")
    name = F.substring_index(trimmed, "/", -1)
    return F.coalesce(F.nullif(F.nullif(F.nullif(name, F.lit("")), F.lit(".")), F.lit("..")), F.lit("unknown"))


def lossy_utf8(raw) -> Column:
    """bytes -> string with invalid sequences replaced."""
    return F.make_valid_utf8(_c(raw).cast("string"))


def _strip(x) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def summary_of(message) -> Column:
    """first paragraph (up to the first blank line), leading blank lines
    skipped, line breaks folded to single spaces, trimmed."""
    m = F.regexp_replace(F.coalesce(_c(message), F.lit("")), r"^\s+", "")
    para = F.regexp_replace(m, r"\n[ \t\r]*\n[\s\S]*$", "")
    return _strip(F.regexp_replace(para, r"\s*\n\s*", " "))


def body_of(message) -> Column:
    """everything after the first blank line, trimmed; NULL when empty."""
    m = F.regexp_replace(F.coalesce(_c(message), F.lit("")), r"^\s+", "")
    rest = F.regexp_extract(m, r"\n[ \t\r]*\n([\s\S]*)$", 1)
    return F.nullif(_strip(rest), F.lit(""))


def change_status(old_blob, new_blob) -> Column:
    """Added / Deleted / Modified (NULL when unchanged)."""
    o, n = _c(old_blob), _c(new_blob)
    return (
        F.when(o.isNull() & n.isNotNull(), F.lit("Added"))
        .when(o.isNotNull() & n.isNull(), F.lit("Deleted"))
        .when(~o.eqNullSafe(n), F.lit("Modified"))
    )
