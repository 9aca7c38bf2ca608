"""Host-level quality rules.

Every document is tested against per-document rules.  The failures are summed
by host, each host's failure rate is shrunk towards the corpus by an empirical
beta prior, and the host's verdict is joined back to its documents.

Null or empty text: no words, so the base rule fails.  A null host is a host of
its own.  Repeated rows count and are returned once each.  Empty input: empty
result.  Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from strata.llm import common

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8

#: per-document rules whose rates are judged by host: name -> condition over the features
RULES = {
    "base": "n_words < 20 or 100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "3 * n_dup_lines > n_lines",
    "word_length": "word_chars < 3 * n_words or word_chars > 12 * n_words",
}
#: a host is dropped when its shrunk failure rate of a rule reaches this
MAX_HOST_RATE = 0.75

FEATURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"

_SYMBOL = np.zeros(256, np.int8)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1


def features(t: common.Texts) -> dict[str, np.ndarray]:
    """The features of every document of a slice."""
    point = (t.data & 0xC0) != 0x80  # one for each code point
    chars = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(point, out=chars[1:])
    word_chars = common.sum_by_doc(chars[t.ends] - chars[t.starts], t.first)

    # lines: they begin where a document does or after a line feed
    feeds = np.flatnonzero(t.data == 10)
    begin = np.unique(np.concatenate([t.offs[:-1], feeds + 1]))
    doc = np.searchsorted(t.offs, begin, "right") - 1
    doc = np.minimum(doc, t.n - 1)
    at_end = np.searchsorted(feeds, begin)
    end = np.minimum(np.append(feeds, len(t.data))[at_end], t.offs[doc + 1])
    keep = (begin <= end) & (np.searchsorted(t.starts, begin) < np.searchsorted(t.starts, end))  # with a word
    begin, end, doc = begin[keep], end[keep], doc[keep]
    prefix = common.prefix_hashes(t.data)
    key = common.mix(common.span_hashes(prefix, begin, end) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    dup = common.seen_before(key)[0]

    words = common.span_hashes(prefix, t.starts, t.ends)
    at, of = t.window_starts(REPEAT_WINDOW)
    grams = common.mix(common.gram_hashes(words, at, REPEAT_WINDOW) + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    twice = common.covered(at[common.seen_before(grams)[1] > 1], REPEAT_WINDOW, len(words))
    return {
        "n_words": t.n_words, "word_chars": word_chars,
        "n_symbols": common.sum_by_doc(_SYMBOL[t.data], t.offs),
        "n_lines": np.bincount(doc, minlength=t.n), "n_dup_lines": np.bincount(doc[dup], minlength=t.n),
        "n_repeat_words": common.sum_by_doc(twice, t.first),
    }


def document_features(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the features, one row for each row of docs."""

    def run(batch):
        for lo, hi, t in common.slices(batch):
            part = batch.slice(lo, hi - lo)
            yield {"doc_id": part.column(0), "host": part.column(1), **features(t)}

    kind = dict(docs.dtypes)["doc_id"]
    src = docs.select("doc_id", F.col(host).cast("string").alias("host"), common.text_or_empty().alias("text"))
    return common.arrow_map(src, run, f"doc_id {kind}, host string, {FEATURES}")


def host_rates(tested: DataFrame) -> DataFrame:
    """host, n_docs and, for each rule, failures and the shrunk rate.

    The prior of a rule is the beta distribution with the mean and variance
    of the hosts' rates (method of moments; each host weighs the same).  If the
    rates vary no more than chance, the prior is worth one corpus-wide
    pseudo-document count and every host gets nearly the mean."""
    hosts = tested.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), *(F.sum(F.col(f"fails_{r}").cast("long")).alias(f"n_{r}") for r in RULES))
    moments = hosts.agg(
        F.avg(1 / F.col("n_docs")).alias("inv"),
        *(F.avg(F.col(f"n_{r}") / F.col("n_docs")).alias(f"m_{r}") for r in RULES),
        *(F.var_pop(F.col(f"n_{r}") / F.col("n_docs")).alias(f"v_{r}") for r in RULES))
    # one row of moments; joined on a constant, it meets every host once
    both = hosts.withColumn("_one", F.lit(1)).join(F.broadcast(moments.withColumn("_one", F.lit(1))), "_one").drop("_one")
    for r in RULES:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        chance = m * (1 - m) * F.col("inv")  # variance that chance alone would give
        spread = F.greatest(v - chance, m * (1 - m) / 1000)
        strength = F.when(spread > 0, F.greatest(m * (1 - m) / spread - 1, F.lit(1.0))).otherwise(F.lit(1.0))
        both = both.withColumn(f"rate_{r}", (F.col(f"n_{r}") + strength * m) / (F.col("n_docs") + strength))
    worst = F.greatest(*(F.col(f"rate_{r}") for r in RULES))
    return both.select("host", "n_docs", *(f"n_{r}" for r in RULES), *(f"rate_{r}" for r in RULES),
                       (worst >= MAX_HOST_RATE).alias("host_failed"))


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """Features, base verdict and final verdict of every document."""
    feats = common.scratch_table(document_features(docs, host), "quality-features")
    tested = feats.select("*", *(F.expr(c).alias(f"fails_{r}") for r, c in RULES.items()))
    hosts = host_rates(tested).select(F.col("host").alias("_host"), "host_failed")
    # verdicts are joined null-safely: documents without a host form one host
    out = tested.join(hosts, F.col("host").eqNullSafe(F.col("_host")), "left")
    return out.select("*", F.col("fails_base").alias("base_failed"),
                      (~F.col("fails_base") & ~F.coalesce(F.col("host_failed"), F.lit(False))).alias("kept"))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Quality verdict of every document, by document rules and host rates."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_failed")
