"""Substring dedup over bytes by difference-cover blockwise suffix sorting.

A byte is removed when it is covered by a LENGTH-byte string that also starts
anywhere else, in another document or in the same one; overlaps count, and
strings are judged on the input, not on what is left.

Strings meet by anchor (see passages), and a task takes its text block by block.
In a block, the suffixes at which strings start are sorted up to LENGTH bytes:

1.  The positions of a difference cover modulo 31 form the sample: for any two
    positions there is a shift below 31 that puts both on the sample.  Sample
    suffixes get ranks over COVER bytes by prefix doubling.
2.  The suffixes are taken one bucket of leading bytes at a time, and sorted by
    their first 32 bytes.
3.  Long ties are resolved by the ranks of the sample suffixes at the pair's
    shift, all ties of the bucket at once, by quicksort partitions around the
    first suffix of each tie.  A shift decides shift + COVER bytes, which is not
    the same number for every pair; suffixes that are equal there are compared
    with the pivot on the bytes up to LENGTH at once, so that every partition
    is by exactly LENGTH bytes and equal strings always stay together.

Memory is that of a block's text and ranks and one bucket's keys, whatever the
lengths of the repeats.

Text is UTF-8; null text is empty.  A row is a document: rows that repeat one
are repeats of its text.  A row without an id is a document too.  A cut may
leave part of a character; what is kept is therefore bytes.  Other columns of
the input are ignored.  Empty input: empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strata.llm import common, passages

LENGTH = 400
GRAM = 64
PERIOD = 31
#: differences of these cover every residue modulo 31
SAMPLE = (1, 5, 11, 24, 25, 27)
#: bytes that sample ranks cover: 11 periods, so that shift + COVER stays below LENGTH
COVER = 11 * PERIOD
BUCKET = 200_000

_IN_SAMPLE = np.zeros(PERIOD, bool)
_IN_SAMPLE[list(SAMPLE)] = True
#: _SHIFT[a, b]: least shift that puts positions of residues a and b on the sample
_SHIFT = np.array([[next(s for s in range(PERIOD) if _IN_SAMPLE[(a + s) % PERIOD] and _IN_SAMPLE[(b + s) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])


def anchors(t: common.Texts) -> passages.Anchors:
    t.first_unit = t.offs
    size = len(t.data)
    grams = np.full(size, np.iinfo(np.uint64).max)
    n = max(size - GRAM + 1, 0)
    if n:
        at = np.arange(n)
        grams[:n] = common.span_hashes(common.prefix_hashes(t.data), at, at + GRAM)
    return passages.Anchors(grams, t.offs, LENGTH, GRAM)


def cut(t: common.Texts, start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return start, start + windows + LENGTH - 1


def words8(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position, as big-endian numbers; text is followed by 8 bytes or more."""
    out = np.zeros(len(text) - 7, np.uint64)
    for i in range(8):
        out |= text[i: len(text) - 7 + i].astype(np.uint64) << np.uint64(56 - 8 * i)
    return out


def dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of keys from 0, equal for equal keys."""
    return np.unique(keys, return_inverse=True)[1].astype(np.uint64)


def cover_ranks(w8: np.ndarray, size: int) -> np.ndarray:
    """At every sample position, the rank of its COVER bytes among all; 0 elsewhere."""
    pos = np.flatnonzero(_IN_SAMPLE[np.arange(size) % PERIOD])
    at = np.zeros(size + LENGTH, np.int64)  # sample index by position; positions after the text share the last, which no window reaches
    at[pos] = np.arange(len(pos))

    rank = dense(w8[pos])
    for shift in (8, 16, 23):  # 31 bytes; the last word overlaps the one before by a byte
        rank = dense(rank << np.uint64(32) | dense(w8[pos + shift]))
    length = PERIOD
    while length < COVER:
        step = min(length, COVER - length)
        rank = dense(rank << np.uint64(32) | rank[at[pos + step]])
        length += step
    out = np.zeros(size + LENGTH, np.uint64)
    out[pos] = rank
    return out


#: the 8-byte words that cover the bytes from COVER to LENGTH
TAIL = range(COVER - 5, LENGTH, 8)


def split_ties(pos: np.ndarray, tie: np.ndarray, ranks: np.ndarray, w8: np.ndarray) -> np.ndarray:
    """Refine ties (a label for each suffix, equal on 32 bytes) into labels of suffixes equal on LENGTH bytes."""
    label = np.zeros(len(pos), np.int64)
    todo, done = np.arange(len(pos)), 0
    tie = tie.copy()
    while len(todo):
        order = np.argsort(tie[todo], kind="stable")
        todo = todo[order]
        new = np.ones(len(todo), bool)
        new[1:] = tie[todo[1:]] != tie[todo[:-1]]
        group = np.cumsum(new) - 1
        pivot = pos[todo[np.flatnonzero(new)]][group]
        p = pos[todo]
        shift = _SHIFT[p % PERIOD, pivot % PERIOD]
        mine, its = ranks[p + shift], ranks[pivot + shift]
        same, above = mine == its, mine > its
        near = np.flatnonzero(same & (p != pivot))
        for k in TAIL:
            a, b = w8[p[near] + k], w8[pivot[near] + k]
            off = a != b
            same[near[off]], above[near[off]] = False, a[off] > b[off]
            near = near[~off]
        label[todo[same]] = done + group[same]
        done += int(group[-1]) + 1
        tie[todo] = group * 2 + above
        todo = todo[~same]
    return label


def repeated_strings(text: np.ndarray, starts: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start: weight of all starts with the same LENGTH bytes, and the index of one of them."""
    w8 = words8(np.concatenate([text, np.zeros(LENGTH + 64, np.uint8)]))
    ranks = cover_ranks(w8, len(text))
    total, head = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    order = np.argsort(w8[starts], kind="stable")
    lead = w8[starts[order]]
    # buckets of leading bytes: cut where the leading word changes, after BUCKET suffixes or more
    change = np.append(np.flatnonzero(lead[1:] != lead[:-1]) + 1, len(order))
    lo = 0
    while lo < len(order):
        hi = int(change[min(np.searchsorted(change, lo + BUCKET), len(change) - 1)])
        index = order[lo:hi]
        pos = starts[index]
        tie = dense(lead[lo:hi])
        for shift in (8, 16, 24):
            tie = dense(tie << np.uint64(32) | dense(w8[pos + shift]))
        label = split_ties(pos, tie.astype(np.int64), ranks, w8)
        n = int(label.max()) + 1
        one = np.full(n, len(pos), np.int64)
        np.minimum.at(one, label, np.arange(len(pos)))
        total[index] = np.bincount(label, weight[index], n).astype(np.int64)[label]
        head[index] = index[one[label]]
        lo = hi
    return total, head


def solve(block: passages.Block) -> passages.Found:
    """Strings that start twice or more, in each occurrence of a block, and the named ones of salted anchors: every
    window that is open, and one witness for each string that is settled here, which may be open in another task."""
    text = np.frombuffer(b"".join(block.bodies), np.uint8)
    offs = np.concatenate(([0], np.cumsum([len(b) for b in block.bodies])))
    counts = np.bincount(block.of, minlength=len(block.bodies))
    begin = np.concatenate(([0], np.cumsum(block.n)))
    starts = common.ranges(offs[:-1], block.n)
    body = np.repeat(np.arange(len(block.bodies)), block.n)
    total, head = repeated_strings(text, starts, counts[body])
    twice = total > 1

    n = block.n[block.of]
    row = np.repeat(np.arange(len(block.of)), n)
    window = common.ranges(begin[:-1][block.of], n)
    inside = window - begin[:-1][block.of][row]
    gone = twice[window]
    who, a, b = passages.ranges_of(gone, row)
    zero = np.zeros(len(who), np.uint64)
    open_ = np.flatnonzero(~gone & block.salted[row])
    salted = np.zeros(len(block.bodies), bool)
    salted[block.of] = block.salted
    witness = np.flatnonzero(twice & salted[body] & (head == np.arange(len(starts))))
    some = np.zeros(len(block.bodies), np.int64)  # an occurrence of each body
    some[block.of] = np.arange(len(block.of))
    named_row = np.concatenate([row[open_], some[body[witness]]])
    named = np.concatenate([inside[open_], witness - begin[:-1][body[witness]]])
    prefix = common.prefix_hashes(text)
    at = starts[np.concatenate([window[open_], witness])]
    w1 = common.span_hashes(prefix, at, at + LENGTH)
    w2 = common.mix(common.span_hashes(prefix, at + 9, at + LENGTH - 9) ^ w1) | np.uint64(1)
    return (np.concatenate([who, named_row]), np.concatenate([inside[a], named]), np.concatenate([inside[b], named]),
            np.concatenate([zero, w1]), np.concatenate([zero, w2]))


def several(rows: DataFrame) -> DataFrame:
    """Named strings that several tasks hold; a witness is removed once more, which changes nothing."""
    often = rows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2")
    return rows.join(often, ["w1", "w2"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every row of docs."""
    spark = docs.sparkSession
    table = common.scratch_table(passages.anchor_table(docs, anchors), "suffix-anchors")
    shared = common.scratch_table(passages.recurring(table, F.col("n") > 1), "suffix-recurring")
    common.release_shuffles(spark)
    found = common.scratch_table(passages.spans(passages.segments(docs, table, shared, anchors, cut), solve, LENGTH, several), "suffix-spans")
    common.release_shuffles(spark)

    def run(batch):
        for lo, hi, t in common.slices(batch):
            part = batch.slice(lo, hi - lo)
            gone = passages.removed(part.column(2), t.offs)
            data = t.data[~gone].tobytes()
            doc = np.repeat(np.arange(t.n), np.diff(t.offs))
            n_removed = common.sum_by_doc(gone, t.offs)
            bound = np.append(0, np.cumsum(np.diff(t.offs) - n_removed)).tolist()
            yield {"doc_id": part.column(0), "n_bytes": np.diff(t.offs), "n_removed": n_removed,
                   "n_spans": np.bincount(passages.ranges_of(gone, doc)[0], minlength=t.n),
                   "kept": pa.array([data[bound[i]: bound[i + 1]] for i in range(t.n)], pa.binary())}

    kind = dict(docs.dtypes)["doc_id"]
    return common.arrow_map(passages.with_spans(docs, found), run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes removed from every document as parts of repeated strings, and a digest of the rest."""
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
