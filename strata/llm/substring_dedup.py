"""Substring dedup over words with repeated-phrase automata.

A window is WINDOW consecutive words of one document.  A word is removed when a
window that covers it has the same words as one that starts in a document with
a smaller id.  Windows are judged on the input, not on what is left.

Recurring passages are confirmed by anchors that two documents share, and dealt
to shards by anchor (see passages).  A shard compiles Aho-Corasick automata
over word numbers: one phrase for every body of text that several documents
hold whole, and one for every window that bodies share in part.  Each phrase
carries the smallest id that holds it.  All bodies are streamed through the
automaton, which reports every occurrence of every phrase, and an occurrence in
a document of a larger id is removed.  For an anchor salted over shards, a
window not removed in its shard is open; the least id of all shards settles it.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged.  Null text: no words.  A row without an id
neither loses words nor takes any from others.  Rows of one id never take words
from each other; equal rows give equal results.  Other columns of the input are
ignored.  Empty input: empty result.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strata.llm import common, passages

WINDOW = 13
GRAM = 5
#: phrases at which an automaton takes no further group
PHRASES = 256
#: rows up to which a counted table is broadcast
BROADCAST_ROWS = 300_000


def anchors(t: common.Texts) -> passages.Anchors:
    t.first_unit = t.first
    words = t.word_hashes()
    n = max(len(words) - GRAM + 1, 0)
    grams = np.full(len(words), np.iinfo(np.uint64).max)
    if n:
        grams[:n] = common.gram_hashes(words, np.arange(n), GRAM)
    return passages.Anchors(grams, t.first, WINDOW, GRAM)


def cut(t: common.Texts, start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return t.starts[start], t.ends[start + windows + WINDOW - 2]


def compiled(phrases: dict[tuple[int, ...], object]) -> ahocorasick.Automaton:
    """An Aho-Corasick automaton over sequences of word numbers."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for phrase, owner in phrases.items():
        automaton.add_word(phrase, (len(phrase), owner))
    automaton.make_automaton()
    return automaton


def solve(block: passages.Block) -> passages.Found:
    """Windows to remove in each occurrence of a block, and the open ones of salted anchors."""
    offs = np.concatenate(([0], np.cumsum([len(b) for b in block.bodies])))
    t = common.Texts(np.frombuffer(b"".join(block.bodies), np.uint8), offs)
    hashes = t.word_hashes()
    number = np.unique(hashes, return_inverse=True)[1]
    least = np.full(len(block.bodies), block.doc.max(), block.doc.dtype)
    np.minimum.at(least, block.of, block.doc)
    most = np.full(len(block.bodies), block.doc.min(), block.doc.dtype)
    np.maximum.at(most, block.of, block.doc)

    # confirm: bodies in several documents, and windows in several bodies
    at, body = t.window_starts(WINDOW)
    # w1, w2 name a window in all shards
    w1 = common.gram_hashes(hashes, at, WINDOW)
    w2 = common.gram_hashes(common.mix(hashes + np.uint64(0x51ED270B)), at, WINDOW)
    shared = common.seen_before(w1)[1] > 1
    whole = least < most
    begin = np.searchsorted(body, np.arange(len(block.bodies) + 1))
    group = np.zeros(len(block.bodies), np.int64)
    group[block.of] = block.rows["group"]

    # stream: least owner of each window of each body.  Phrases of one anchor are never found under another,
    # so an automaton takes whole groups, and their bodies pass through it alone
    first, numbers, least_of = t.first.tolist(), number.tolist(), least.tolist()
    starts, shared_of, whole_of = at.tolist(), shared.tolist(), whole.tolist()
    owner = least[body]
    lo = 0
    phrases: dict[tuple[int, ...], object] = {}
    for i in range(len(block.bodies)):
        if whole_of[i]:
            key = tuple(numbers[first[i]: first[i + 1]])
            phrases[key] = min(phrases.get(key, least_of[i]), least_of[i])
        for w in range(begin[i], begin[i + 1]):
            if shared_of[w]:
                key = tuple(numbers[starts[w]: starts[w] + WINDOW])
                phrases[key] = min(phrases.get(key, least_of[i]), least_of[i])
        if i + 1 < len(block.bodies) and (len(phrases) < PHRASES or group[i + 1] == group[i]):
            continue
        if phrases:
            automaton = compiled(phrases)
            for j in range(lo, i + 1):
                for end, (length, by) in automaton.iter(tuple(numbers[first[j]: first[j + 1]])):
                    if by < least_of[j]:
                        a = begin[j] + end - length + 1
                        np.minimum(owner[a: a + length - WINDOW + 1], by, out=owner[a: a + length - WINDOW + 1])
        lo, phrases = i + 1, {}

    # an occurrence loses the windows that a smaller document owns
    n = np.diff(begin)[block.of]
    row = np.repeat(np.arange(len(block.of)), n)
    window = common.ranges(begin[:-1][block.of], n)
    inside = window - begin[:-1][block.of][row]
    lost = owner[window] < block.doc[row]
    who, a, b = passages.ranges_of(lost, row)
    zero = np.zeros(len(who), np.uint64)
    open_ = np.flatnonzero(~lost & block.salted[row])
    return (np.concatenate([who, row[open_]]), np.concatenate([inside[a], inside[open_]]), np.concatenate([inside[b], inside[open_]]),
            np.concatenate([zero, w1[window[open_]]]), np.concatenate([zero, w2[window[open_]] | np.uint64(1)]))


def least_owner(rows: DataFrame) -> DataFrame:
    owner = rows.groupBy("w1", "w2").agg(F.min("doc_id").alias("owner"))
    return rows.join(owner, ["w1", "w2"]).where("doc_id > owner")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the remaining words, joined by one space) of every row of docs."""
    spark = docs.sparkSession
    # a document whose whole text a smaller id has too loses all its windows, and takes none from others that the smaller does not
    named = docs.where("doc_id is not null").select("doc_id", F.xxhash64(common.text_or_empty()).alias("version"), F.xxhash64(common.text_or_empty(), F.lit(1)).alias("check"))
    owner = named.groupBy("version", "check").agg(F.min("doc_id").alias("owner"))
    copies = common.scratch_table(named.join(owner, ["version", "check"]).where("doc_id > owner").select("doc_id", "version").distinct(), "phrases-copies")
    few = F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies
    own = passages.keyed(docs.where("doc_id is not null")).join(few, ["doc_id", "version"], "left_anti").select("doc_id", "text")
    table = common.scratch_table(passages.anchor_table(own, anchors), "phrases-anchors")
    shared = common.scratch_table(passages.recurring(table, F.col("low") < F.col("high")), "phrases-recurring")
    common.release_shuffles(spark)
    found = common.scratch_table(passages.spans(passages.segments(own, table, shared, anchors, cut), solve, WINDOW, least_owner), "phrases-spans")
    whole = F.array(F.struct(F.lit(passages.WHOLE).cast("long").alias("low"), F.lit(passages.WHOLE).cast("long").alias("high")))
    found = found.union(copies.select("doc_id", "version", whole.alias("spans")))
    common.release_shuffles(spark)

    def run(batch):
        for lo, hi, t in common.slices(batch):
            part = batch.slice(lo, hi - lo)
            kept = ~passages.removed(part.column(2), t.first, WINDOW)
            # kept words and the byte after each, which becomes the space
            size = (t.ends - t.starts)[kept]
            out = np.append(t.data, np.uint8(32))[common.ranges(t.starts[kept], size + 1)]
            ends = np.cumsum(size + 1)
            out[ends - 1] = 32
            data = out.tobytes()
            count = common.sum_by_doc(kept, t.first)
            bound = np.append(0, ends)[np.append(0, np.cumsum(count))].tolist()
            yield {"doc_id": part.column(0), "n_words": t.n_words, "n_removed": t.n_words - count,
                   "kept": pa.array([data[bound[i]: max(bound[i], bound[i + 1] - 1)] for i in range(t.n)], pa.binary()).cast(pa.string())}

    kind = dict(docs.dtypes)["doc_id"]
    return common.arrow_map(passages.with_spans(docs, found), run, f"doc_id {kind}, n_words long, n_removed long, kept string")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words removed from every document as repeats of smaller documents, and a digest of the rest."""
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
