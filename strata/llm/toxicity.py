"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed lower-case terms (words, and their first
bytes, which inflections of a word share).  Its score is
    sigmoid(bias + sum of w[i] + sum over pairs i < j of <v[i], v[j]>),
so two terms that are harmless alone (an insult quoted, a group mentioned) can
be toxic together, which additive weights cannot express.  The pair sum costs
one pass over the terms: half of |sum v|^2 - sum |v|^2.

Fitted on at most MAX_TRAIN labelled documents, those with the smallest hashes
of their id.  A term has weights if at least MIN_DOCS of them hold it and its
share of toxic documents is MIN_Z standard errors from the overall one, or if
it is one of a pair whose share
differs from what the two terms alone make likely (together), whatever its own
share is.  The sample bounds the model, which is broadcast to the scoring tasks.

Null or empty text, or a text without a known term: the bias alone.  Labels
that are null are ignored; a document labelled more than once counts once, as
toxic if any of its labels says so.  Without labels of both classes every score
is the smoothed rate of the class at hand, kept under one half where no row is
toxic.  Repeated rows are scored alike.  Empty input: empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strata.llm import common

MAX_TRAIN = 16000
MIN_DOCS = 4
MIN_Z = 3.0
FACTORS = 6
EPOCHS = 12
BATCH = 256
RATE = 0.1
PREFIXES = (4, 5)
DOCS_AT_ONCE = 1000  # documents of a term whose further terms are counted at once
L2_LINEAR, L2_PAIR = 2e-4, 2e-3

#: characters cut off both ends of a word to make a term
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in ".,;:!?\"'()[]{}<>*_-#%$&|"]] = True


def term_hashes(t: common.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of a slice, and the document of each.  t: lower-cased.

    A word gives itself, without the punctuation at its ends, and its first
    PREFIXES bytes, which it shares with its inflections."""
    inner = np.flatnonzero(~_EDGE[t.data])
    if len(inner) == 0 or len(t.starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    a = np.searchsorted(inner, t.starts)
    b = np.searchsorted(inner, t.ends) - 1
    ok = b >= a
    begin, end, doc = inner[a[ok]], inner[b[ok]] + 1, t.doc_of_word()[ok]
    sums = common.prefix_hashes(t.data)
    found = [(common.span_hashes(sums, begin, end), doc)]
    for n in PREFIXES:
        longer = np.flatnonzero(end - begin > n)
        found.append((~common.span_hashes(sums, begin[longer], begin[longer] + n), doc[longer]))
    return np.concatenate([h for h, _ in found]), np.concatenate([d for _, d in found])


def distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hash) pairs, ordered by document."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


class Model:
    """Weights by term; terms: their sorted hashes."""

    def __init__(self, terms, bias, linear, pairs):
        self.terms, self.bias, self.linear, self.pairs = terms, bias, linear, pairs
        if len(terms):  # a small table says of most words at once that they are unknown
            self.slot = np.zeros(1 << 22, bool)
            self.slot[(terms >> np.uint64(42)).astype(np.int64)] = True

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h of known terms, and their indices."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.slot[(h >> np.uint64(42)).astype(np.int64)])
        i = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
        hit = self.terms[i] == h[at]
        return at[hit], i[hit]

    def scores(self, index: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        z = np.full(n, self.bias) + np.bincount(doc, self.linear[index], n)
        for f in range(self.pairs.shape[1]):
            v = self.pairs[index, f]
            z += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def together(index: np.ndarray, lengths: np.ndarray, labels: np.ndarray, counts: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Terms of pairs whose toxic share is not what their two terms, added up, make likely.

    index: term of each entry, ordered by document.  A pair counts when the Chernoff
    bound of its share, given the sum of the two terms' log-odds, is below one over the
    number of pairs: no pair is expected to get in by chance.  Pairs in too few documents
    to pass against the overall share, were they all toxic, are not tested."""
    none = np.zeros(0, np.int64)
    if not 0 < labels.sum() < len(labels):
        return none
    rate = labels.mean()
    wide = np.flatnonzero(counts >= MIN_DOCS)
    bar = np.log(max(len(wide), 2) ** 2 / 2)
    least = int(np.ceil(bar / -np.log(min(rate, 1 - rate))))
    wide = np.flatnonzero(counts >= max(least, MIN_DOCS))
    if len(wide) < 2:
        return none
    number = np.full(len(counts), -1)
    number[wide] = np.arange(len(wide))
    term = number.astype(np.int32)[index]
    doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[term >= 0]
    term = term[term >= 0]
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    del order
    last = np.searchsorted(doc, np.arange(len(lengths)), "right").astype(np.int32)  # the terms after an entry, in its document, end here
    toxic_doc = labels > 0
    by_term = np.lexsort((toxic_doc[doc], term)).astype(np.int32)
    cut = np.searchsorted(term, np.arange(len(wide) + 1), sorter=by_term)
    clean = cut[:-1] + np.bincount(term[~toxic_doc[doc]], minlength=len(wide))
    share = (toxic[wide] + rate) / (counts[wide] + 1)
    odds = np.log(share / (1 - share))
    base = np.log(rate / (1 - rate))
    found = np.zeros(len(wide), bool)
    for i in range(len(wide) - 1):
        k = []
        for lo, hi in ((cut[i], clean[i]), (clean[i], cut[i + 1])):
            for a in range(lo, max(hi, lo + 1), DOCS_AT_ONCE):
                at = by_term[a: min(a + DOCS_AT_ONCE, hi)]
                part = np.bincount(term[common.ranges(at + 1, last[doc[at]] - at - 1)] - (i + 1), minlength=len(wide) - i - 1)
                if a == lo:
                    k.append(part)
                else:
                    k[-1] += part
        n = k[0] + k[1]
        j = np.flatnonzero(n >= least)
        n, q = n[j], k[1][j] / n[j]
        e = 1 / (1 + np.exp(-(odds[i] + odds[i + 1 + j] - base)))
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = np.where(q > 0, q * np.log(q / e), 0) + np.where(q < 1, (1 - q) * np.log((1 - q) / (1 - e)), 0)
        hit = j[n * gap >= bar]
        if len(hit):
            found[i] = found[i + 1 + hit] = True
    return wide[found]


def entries(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The terms that MIN_DOCS documents hold, sorted, and of each of their entries, ordered by document, term and document.

    Rarer terms, which no weight is learned for, are most of a sample; they are
    left out before anything is worked out for each entry."""
    flat = np.concatenate(hashes) if len(hashes) else np.zeros(0, np.uint64)
    flat.sort()
    n = max(len(flat) - MIN_DOCS + 1, 0)  # of the entries in order, one that equals the one MIN_DOCS - 1 later
    found = np.unique(flat[:n][flat[:n] == flat[len(flat) - n:]])
    del flat
    index, doc = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for d, h in enumerate(hashes if len(found) else ()):
        i = np.minimum(np.searchsorted(found, h), len(found) - 1)
        i = i[found[i] == h].astype(np.int32)
        index.append(i)
        doc.append(np.full(len(i), d, np.int32))
    return found, np.concatenate(index), np.concatenate(doc)


def fit(hashes: list[np.ndarray], labels: np.ndarray) -> Model:
    """AdaGrad on the logistic loss, in mini-batches of a fixed order."""
    rate = (labels.sum() + 0.5) / (len(labels) + 1) if len(labels) else 0.0
    none = np.zeros(0)
    found, index, doc = entries(hashes)
    lengths = np.bincount(doc, minlength=len(hashes))
    counts = np.bincount(index, minlength=len(found))
    toxic = np.bincount(index, labels[doc], len(found))
    z = (toxic - counts * rate) / np.sqrt(counts * rate * (1 - rate) + 1e-9)
    pick = np.union1d(np.flatnonzero(np.abs(z) >= MIN_Z), together(index, lengths, labels, counts, toxic))
    terms = found[pick]
    if not 0 < labels.sum() < len(labels) or not len(terms):
        rate = min(max(rate, 1e-6), 1 - 1e-6)
        if not labels.sum():
            rate = min(rate, 0.49)
        return Model(np.zeros(0, np.uint64), float(np.log(rate / (1 - rate))), none, np.zeros((0, FACTORS)))
    number = np.full(len(found), -1)
    number[pick] = np.arange(len(pick))
    index = number[index]
    doc, index = doc[index >= 0], index[index >= 0]
    first = np.searchsorted(doc, np.arange(len(hashes) + 1))

    # both classes weigh the same, so that a score of one half is where they balance
    weight = np.where(labels > 0, 0.5 / rate, 0.5 / (1 - rate))
    rng = np.random.default_rng(0)
    k = len(terms)
    w, v, b = np.zeros(k), rng.normal(0, 0.01, (k, FACTORS)), 0.0
    gw, gv, gb = np.full(k, 1e-2), np.full((k, FACTORS), 1e-1), 1e-2
    for _ in range(EPOCHS):
        order = rng.permutation(len(hashes))
        for lo in range(0, len(order), BATCH):
            docs = order[lo: lo + BATCH]
            n = first[docs + 1] - first[docs]
            at = common.ranges(first[docs], n)
            x, d = index[at], np.repeat(np.arange(len(docs)), n)
            sums = np.stack([np.bincount(d, v[x, f], len(docs)) for f in range(FACTORS)], 1)
            z = b + np.bincount(d, w[x], len(docs)) + 0.5 * (
                (sums ** 2).sum(1) - sum(np.bincount(d, v[x, f] ** 2, len(docs)) for f in range(FACTORS)))
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[docs]) * weight[docs] / len(docs)
            gb += err.sum() ** 2
            b -= RATE * err.sum() / np.sqrt(gb)
            e = err[d]
            terms_here, back = np.unique(x, return_inverse=True)
            g = np.bincount(back, e) + L2_LINEAR * w[terms_here]
            gw[terms_here] += g * g
            w[terms_here] -= RATE * g / np.sqrt(gw[terms_here])
            for f in range(FACTORS):
                g = np.bincount(back, e * (sums[d, f] - v[x, f])) + L2_PAIR * v[terms_here, f]
                gv[terms_here, f] += g * g
                v[terms_here, f] -= RATE * g / np.sqrt(gv[terms_here, f])
    return Model(terms, b, w, v)


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """text and toxic of at most max_train labelled documents outside the held-out fold."""
    marked = (labels.where("toxic is not null and doc_id is not null")
              .where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    # at most max_train rows, so the broadcast is bounded; a document that occurs in several rows gives one training row
    return (docs.select("doc_id", common.text_or_empty().alias("text")).join(F.broadcast(marked), "doc_id")
            .groupBy("doc_id").agg(F.max("text").alias("text"), F.first("toxic").alias("toxic")))


def held_out(doc_id: str):
    """The documents that no label is learned from: a fifth, by the checksum of the id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on the bounded sample, in one task; the model's rows come back to the driver."""

    def hashed(batch):
        for lo, hi, t in common.slices(batch, lower=True):
            h, doc = distinct(*term_hashes(t))
            cut = np.searchsorted(doc, np.arange(t.n + 1))
            part = batch.slice(lo, hi - lo)
            yield {"doc_id": part.column(0), "toxic": part.column(2), "terms": [h[cut[i]: cut[i + 1]].tobytes() for i in range(t.n)]}

    rows = training_rows(docs, labels, max_train)
    kind = dict(docs.dtypes)["doc_id"]
    sample = common.arrow_map(rows.select("doc_id", "text", "toxic"), hashed, f"doc_id {kind}, toxic int, terms binary")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        m = fit([np.frombuffer(x, np.uint64) for x in pdf["terms"]], (pdf["toxic"].to_numpy() > 0).astype(float))
        return pd.DataFrame({"bias": [m.bias], "terms": [m.terms.tobytes()], "linear": [m.linear.tobytes()], "pairs": [m.pairs.tobytes()]})

    # at most max_train rows, by the limit above, so one group is bounded
    got = sample.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(learn, "bias double, terms binary, linear binary, pairs binary").first()
    if got is None:
        return fit([], np.zeros(0))
    return Model(np.frombuffer(got["terms"], np.uint64), got["bias"], np.frombuffer(got["linear"]), np.frombuffer(got["pairs"]).reshape(-1, FACTORS))


def scorer(spark, model: Model):
    """A function of a batch that yields its slices' bounds and scores; the model is broadcast, its size is bounded."""
    shared = spark.sparkContext.broadcast((model.terms, model.bias, model.linear, model.pairs))
    made = {}

    def run(batch):
        m = made.get("m") or made.setdefault("m", Model(*shared.value))
        for lo, hi, t in common.slices(batch, lower=True):
            h, doc = term_hashes(t)
            at, index = m.known(h)
            pair = np.sort(doc[at] << 32 | index)  # each known term counts once in a document
            pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
            yield lo, hi, m.scores(pair & 0xFFFFFFFF, pair >> 32, t.n)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs."""
    scores = scorer(docs.sparkSession, model)

    def run(batch):
        for lo, hi, values in scores(batch):
            yield {"doc_id": batch.slice(lo, hi - lo).column(0), "score": values}

    kind = dict(docs.dtypes)["doc_id"]
    return common.arrow_map(docs.select("doc_id", common.text_or_empty().alias("text")), run, f"doc_id {kind}, score double")


def below(docs: DataFrame, model: Model, limit: float) -> DataFrame:
    """The rows of docs with a score under limit, unchanged."""
    scores = scorer(docs.sparkSession, model)

    def run(batches):
        for batch in batches:
            for lo, hi, values in scores(batch):
                yield batch.slice(lo, hi - lo).filter(pa.array(values < limit))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    out = score(docs, train(docs, labels, max_train))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labelled ones outside the held-out fold."""
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
