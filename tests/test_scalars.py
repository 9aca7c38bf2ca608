"""Scalar functions on hand-written edge cases."""
import datetime as dt

from pyspark.sql import functions as F

from strata.functions import scalars as S


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_short_oid_and_first_line(spark):
    assert one(spark, S.short_oid("x"), "0123456789abcdef") == "01234567"
    assert one(spark, S.first_line("x"), None) == ""
    assert one(spark, S.first_line("x"), "") == ""
    assert one(spark, S.first_line("x"), "subject\r\nbody") == "subject"
    assert one(spark, S.first_line("x"), "\nsecond") == ""


def test_is_valid_oid(spark):
    good = "a" * 40
    cases = {good: True, good.upper(): True, "a" * 39: False, "a" * 41: False, "g" + "a" * 39: False,
             good + "\n": False, None: False}
    for v, want in cases.items():
        assert one(spark, S.is_valid_oid("x"), v) is want, v


def test_ref_names(spark):
    assert one(spark, S.short_ref("x"), "refs/remotes/origin/feature/a/b") == "feature/a/b"
    assert one(spark, S.short_ref("x"), "refs/heads/main") == "main"
    assert one(spark, S.short_ref("x"), "main") == "main"
    assert one(spark, S.short_ref("x"), "refs/remotes/origin/refs/heads/x") == "refs/heads/x"
    assert one(spark, S.strip_origin("x"), "origin/dev") == "dev"
    assert one(spark, S.full_ref("x"), "origin/dev") == "refs/remotes/origin/dev"
    assert one(spark, S.ensure_origin("x"), "dev") == "origin/dev"
    assert one(spark, S.ensure_origin("x"), "origin/dev") == "origin/dev"


def test_parents_text_roundtrip(spark):
    assert one(spark, S.parents_from_text("x"), "") == []
    assert one(spark, S.parents_from_text("x"), "a,b") == ["a", "b"]
    assert one(spark, S.parents_to_text("x"), [], "x array<string>") == ""


def test_escape_and_html(spark):
    assert one(spark, S.escape_html("x"), "a<b>&c") == "a&lt;b&gt;&amp;c"
    df = spark.createDataFrame([("+", "x<y"), ("-", "a"), (" ", "c"), ("\\", "raw")], "o string, c string")
    got = [r[0] for r in df.select(S.diff_line_html("o", "c")).collect()]
    assert got == ['<span class="diff-add-line">x&lt;y</span>', '<span class="diff-remove-line">a</span>',
                   '<span class="diff-context"> c</span>', "raw"]


def test_diff_stats_text(spark):
    df = spark.createDataFrame([(1, 1, 0)], "f long, i long, d long")
    assert df.select(S.format_diff_stats("f", "i", "d")).first()[0] == "1 files changed, 1 insertions(+), 0 deletions(-)"


def test_time_functions(spark):
    now = dt.datetime(2024, 2, 1, 0, 0, 0)
    rows = [(now - dt.timedelta(seconds=s),) for s in [30, 60, 61, 3601, 86401, 2592001, 31536001, 8 * 86400 + 5]]
    df = spark.createDataFrame(rows, "t timestamp_ntz")
    n = F.lit(now).cast("timestamp_ntz")
    ago = [r[0] for r in df.select(S.time_ago("t", n)).collect()]
    assert ago[:7] == ["30 seconds ago", "60 seconds ago", "1 minutes ago", "1 hours ago", "1 days ago",
                       "1 months ago", "1 years ago"]
    rel = [r[0] for r in df.select(S.relative_date("t", n)).collect()]
    assert rel[0] == "Just now" and rel[2] == "1 min ago" and rel[4] == "1 day ago" and rel[7] == "2024-01-23"
    assert df.select(S.rfc3339(F.lit(now).cast("timestamp_ntz"))).first()[0] == "2024-02-01T00:00:00+00:00"
    assert df.select(S.epoch_to_ts(S.ts_to_epoch(F.lit(now).cast("timestamp_ntz")))).first()[0] == now


def test_paths(spark):
    cases = {"/a/b": "b", "/a/b/": "b", "/a/b/.": "b", "/a/b/./": "b", "/": "unknown", "/a/..": "unknown"}
    for p, want in cases.items():
        assert one(spark, S.path_basename("x"), p) == want, p
    assert one(spark, S.path_join(F.lit("/base/"), F.col("x")), "/rel") == "/base/rel"


def test_summary_and_body(spark):
    m = "\n\n Subject line\ncontinued \n\n body one\n\nbody two \n"
    assert one(spark, S.summary_of("x"), m) == "Subject line continued"
    assert one(spark, S.body_of("x"), m) == "body one\n\nbody two"
    assert one(spark, S.body_of("x"), "only subject") is None
    assert one(spark, S.summary_of("x"), None) == ""


def test_change_status_and_utf8(spark):
    df = spark.createDataFrame([(None, "b"), ("a", None), ("a", "b"), ("a", "a")], "o string, n string")
    assert [r[0] for r in df.select(S.change_status("o", "n")).collect()] == ["Added", "Deleted", "Modified", None]
    raw = spark.createDataFrame([(bytearray(b"ok\xff"),)], "b binary")
    assert raw.select(S.lossy_utf8("b")).first()[0] == "ok�"
