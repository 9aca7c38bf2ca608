"""Language-model scores by logistic context mixing.

The model sees a text as bytes: its words, lower-cased (A-Z), joined by one
space, and an end byte.  A byte is a path of binary decisions in a Huffman tree
of the corpus's bytes.  Each decision is predicted by several hashed contexts:
the last two bytes, the last three, and the word so far.
A context holds, at every node of the tree, the log-odds of its counts over all
training documents.  A gate, the position in the word, picks the set of weights
that mixes the log-odds; the weights move online, after every byte, down the
gradient of the coding cost.  An adaptive map from the mixed probability to the
outcomes seen refines it.  The logarithms of all decisions sum to that of the
text's probability.

Learning is by Spark aggregation: tasks count (context, byte) cells over all
training documents, the counts are summed, and the tables of log-odds, of fixed
size (TABLES, one byte a node), are broadcast.  Starting weights are fitted to all
training documents: in each of ROUNDS, tasks sum the gradient and curvature of the
coding cost over their bytes, and the sums give a Newton step for each gate.  Bytes of
equal contexts have equal slopes, so a task takes each distinct one once, times its count.
Online state starts anew every LANE bytes and never leaves a document, so a score
depends on the model and the text alone.

The base score is that of single words: sum of log10((c + 0.5) / (N + 0.5 (V + 1)))
over words and the end.  Vocabularies grow with the corpus and are not
broadcast: chunks of documents ask for the counts of their distinct words in a
join and get them back in a cogroup.

Null text is empty: the end alone.  A row is held out by the checksum of its
id; a null id is in training.  Rows that repeat a document count each time.
Other columns of the input are ignored.  Empty input: empty result.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strata.llm import common

#: bits of the context index of each table: last two bytes, last three, word so far
TABLES = (12, 14, 14)
GATES = 4
ROUNDS = 1  # Newton steps to the starting weights
PIECE = 1 << 15  # bytes whose slopes are taken at once
LANE = 512
#: steps whose bytes are fetched at once, distinct bytes in context that a task holds: memory only
STRIDE, HELD = 16, 1 << 21
LEARN, REFINE = 0.01, 0.02
STEPS = 33  # cells of the refining map
CHUNK_BYTES = 8 << 20
END, SPACE = 10, 32

_BASE = np.concatenate(([0], np.cumsum([1 << b for b in TABLES])))  # rows of the tables, one after the other


def in_training(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 != 1, F.lit(True))


def normalized(t: common.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Words joined by spaces, an end byte after each document.  t: lower-cased."""
    size = t.ends - t.starts
    per_doc = common.sum_by_doc(size + 1, t.first) + (t.n_words == 0)
    offs = np.concatenate(([0], np.cumsum(per_doc)))
    out = np.full(offs[-1], SPACE, np.uint8)
    before = np.cumsum(size + 1) - (size + 1) + np.cumsum(t.n_words == 0)[t.doc_of_word()]
    out[common.ranges(before, size)] = t.data[common.ranges(t.starts, size)]
    out[offs[1:] - 1] = END
    return out, offs


def contexts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte: its row in each table (bytes x tables), and its gate."""
    rows, gate = np.empty((len(data), len(TABLES)), np.int32), np.empty(len(data), np.int64)
    for lo, hi in runs(offs, PIECE):  # arrays that stay in the processor's cache
        a, b = offs[lo], offs[hi]
        rows[a:b], gate[a:b] = _contexts(data[a:b], offs[lo: hi + 1] - a)
    return rows, gate


def _contexts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = len(data)
    last = []
    for i in (1, 2, 3):
        before = np.full(size, END, np.uint8)
        before[i:] = data[:-i]
        for j in range(i):  # the byte lies ahead of its document
            at = offs[:-1] + j
            before[at[at < offs[1:]]] = END
        last.append(before)
    starts = np.zeros(size, bool)
    starts[offs[:-1]] = True
    starts[1:] |= data[:-1] == SPACE
    here = np.arange(size)
    word = np.maximum.accumulate(here * starts)
    since = here - word
    prefix = common.prefix_hashes(data)
    rows = np.empty((size, len(TABLES)), np.int32)
    two = last[0] | last[1].astype(np.int64) << 8
    rows[:, 0] = _of_two().take(two)
    top = lambda h, bits: (common.mix(h) >> np.uint64(64 - bits)).astype(np.int32)
    rows[:, 1] = _BASE[1] + top((two | last[2].astype(np.int64) << 16 | 1 << 41).view(np.uint64), TABLES[1])
    rows[:, 2] = _BASE[2] + top(common.spans_to(prefix, word, since) ^ np.uint64(1 << 42), TABLES[2])
    return rows, np.minimum(since, GATES - 1)


@functools.cache
def _of_two() -> np.ndarray:
    """The row of each two bytes in the first table."""
    return (common.mix(np.arange(1 << 16, dtype=np.uint64) | np.uint64(1 << 40)) >> np.uint64(64 - TABLES[0])).astype(np.int32)


class Code:
    """Huffman code of bytes by their counts: nodes and bits of each byte's path."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(c) + 1, b, b) for b, c in enumerate(counts)]
        heapq.heapify(heap)
        child = {}
        node = 256
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            child[node] = (a[2], b[2])
            heapq.heappush(heap, (a[0] + b[0], node, node))
            node += 1
        paths: dict[int, list[tuple[int, int]]] = {}
        stack = [(node - 1, [])]
        while stack:
            at, path = stack.pop()
            if at < 256:
                paths[at] = path
            else:
                for bit in (0, 1):
                    stack.append((child[at][bit], [*path, (at - 256, bit)]))
        self.length = np.array([len(paths[b]) for b in range(256)], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.length)))
        self.node = np.array([n for b in range(256) for n, _ in paths[b]], np.int32)
        self.bit = np.array([x for b in range(256) for _, x in paths[b]], np.float32)

    def log_odds(self, counts: np.ndarray) -> np.ndarray:
        """counts (contexts x 256) to log-odds of bit 1 at each node, in sixteenths."""
        leaf = np.repeat(np.arange(256), self.length)
        n = []
        for bit in (0, 1):
            under = np.zeros((256, 256), np.float32)
            here = self.bit == bit
            under[leaf[here], self.node[here]] = 1
            n.append(counts.astype(np.float32) @ under)
        return np.clip(np.rint(16 * np.log((n[1] + 0.05) / (n[0] + 0.05))), -127, 127).astype(np.int8)


class Mixer:
    """Tables, code and starting weights."""

    def __init__(self, code: Code, table: np.ndarray, weights: np.ndarray):
        self.code, self.table, self.weights = code, table.reshape(-1), weights

    def cost(self, data: np.ndarray, offs: np.ndarray, learn: float = LEARN) -> np.ndarray:
        """Bits of each document."""
        rows, gate = contexts(data, offs)
        # documents are cut to lanes; the longest first, so that lanes end from the back
        n_lanes = -(-np.diff(offs) // LANE)
        doc = np.repeat(np.arange(len(offs) - 1), n_lanes)
        begin = offs[:-1][doc] + common.ranges(np.zeros(len(n_lanes), np.int64), n_lanes) * LANE
        size = np.minimum(offs[1:][doc] - begin, LANE)
        order = np.argsort(-size, kind="stable")
        doc, begin, size = doc[order], begin[order], size[order]
        lanes = np.arange(len(begin))
        # one array for each predictor; the weights of lane l and gate g are at l * GATES + g
        w = [np.tile(self.weights[:, k].astype(np.float32), len(lanes)) for k in range(len(TABLES))]
        refine = np.tile((1 / (1 + np.exp(-np.linspace(-8, 8, STEPS)))).astype(np.float32), len(lanes))
        bits = np.zeros(len(lanes))
        active = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left").tolist()  # lanes longer than s
        code, table, rate = self.code, self.table, np.float32(learn / 256)
        node_of, count = code.node.astype(np.int64), np.arange(int(code.length.max()) * len(lanes))
        for s, n in enumerate(active):
            j = s % STRIDE
            if j == 0:  # bytes of so many steps at once, each step's in a row
                at = np.minimum(begin[:n, None] + np.arange(s, s + STRIDE), len(data) - 1)
                symbols = np.ascontiguousarray(data[at].T)
                sets = gate[at].T + lanes[:n] * GATES
                base = np.ascontiguousarray(rows[at].transpose(2, 1, 0)).astype(np.int64) * 256
                lengths = code.length[symbols]
                starts = code.first[symbols]
            length, set_ = lengths[j, :n], sets[j, :n]
            # a decision's lane, and its place in the code
            lane = np.repeat(lanes[:n], length)
            path = (starts[j, :n] + length - np.cumsum(length)).take(lane)
            path += count[: len(path)]
            node, bit = node_of.take(path), code.bit.take(path)
            hint, own = [], [x.take(set_) for x in w]  # weights are per sixteenth of log-odds
            for b in base:
                cell = b[j, :n].take(lane)
                cell += node
                hint.append(table.take(cell).astype(np.float32))
            z = own[0].take(lane)
            z *= hint[0]
            for x, h in zip(own[1:], hint[1:], strict=True):
                part = x.take(lane)
                part *= h
                z += part
            np.clip(z, -8, 8, out=z)
            p = np.negative(z)
            np.exp(p, out=p)
            p += 1
            np.reciprocal(p, out=p)
            z *= np.float32((STEPS - 1) / 16)
            z += np.float32(STEPS / 2)
            cell = z.astype(np.int64)
            lane_cells = lane * STEPS
            cell += lane_cells
            seen = refine.take(cell)
            # the probability given to the bit that came: half of p + seen, or 1 less it
            final = p + seen
            final *= np.float32(0.5)
            final -= 1 - bit
            np.abs(final, out=final)
            np.maximum(final, np.float32(1 / 4096), out=final)
            bits[:n] -= np.bincount(lane, np.log2(final, out=final), n)
            step = bit - seen
            step *= np.float32(REFINE)
            step += seen
            refine[cell] = step
            error = bit - p
            error *= rate
            for k in range(len(TABLES)):
                hint[k] *= error
                w[k][set_] = own[k] + np.bincount(lane, hint[k], n).astype(np.float32)
        return np.bincount(doc, bits, len(offs) - 1)

    def slopes(self, keys: np.ndarray, times: np.ndarray) -> np.ndarray:
        """For each gate, the gradient of the log-probability in its weights and, after it, the curvature, over
        bytes given as distinct keys and how often each occurs."""
        n, code = len(TABLES), self.code
        total = np.zeros((n + n * n, GATES))
        for lo in range(0, len(keys), PIECE):
            rows, g, symbol = opened(keys[lo: lo + PIECE])
            length = code.length[symbol]
            ends = np.cumsum(length)
            first = ends - length
            byte = np.repeat(np.arange(len(symbol)), length)
            path = np.arange(ends[-1]) + (code.first[symbol] - first).take(byte)
            node = code.node[path]
            hint = [self.table.take((x * 256).take(byte) + node).astype(np.float32) for x in rows]
            z = sum(self.weights[g, k].astype(np.float32).take(byte) * hint[k] for k in range(n))
            p = 1 / (1 + np.exp(-np.clip(z, -8, 8)))
            error, spread = code.bit[path] - p, p * (1 - p)
            by_gate = lambda x: np.bincount(g, times[lo: lo + PIECE] * np.add.reduceat(x, first), GATES)
            for k in range(n):
                total[k] += by_gate(error * hint[k])
                part = spread * hint[k]
                for m in range(k, n):
                    here = by_gate(part * hint[m])
                    total[n + k * n + m] += here
                    if m > k:
                        total[n + m * n + k] += here
        return total.T


def keyed(data: np.ndarray, rows: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """A number for each byte that holds its rows, its gate and itself; 50 bits."""
    key = np.zeros(len(data), np.uint64)
    for k, bits in enumerate(TABLES):
        key = key << np.uint64(bits) | (rows[:, k] - _BASE[k]).astype(np.uint64)
    return (key << np.uint64(2) | gate.astype(np.uint64)) << np.uint64(8) | data.astype(np.uint64)


def opened(key: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Rows (one array a table), gates and bytes of keys."""
    symbol, gate, key = (key & np.uint64(255)).astype(np.int64), (key >> np.uint64(8) & np.uint64(3)).astype(np.int64), key >> np.uint64(10)
    rows = []
    for k in range(len(TABLES) - 1, -1, -1):
        rows.insert(0, (key & np.uint64((1 << TABLES[k]) - 1)).astype(np.int64) + _BASE[k])
        key = key >> np.uint64(TABLES[k])
    return rows, gate, symbol


class Tally:
    """Distinct keys and how often each occurs, of slices put in one after the other."""

    def __init__(self):
        self.keys, self.times = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        keys, times = np.unique(keys, return_counts=True)
        both, own = np.concatenate([self.keys, keys]), np.concatenate([self.times, times])
        order = np.argsort(both, kind="stable")
        both, own = both[order], own[order]
        begin = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
        self.keys, self.times = both[begin], np.add.reduceat(own, begin) if len(both) else own


def runs(offs: np.ndarray, limit: int):
    """(lo, hi) of documents that hold about limit bytes together; a longer one is alone."""
    lo = 0
    while lo < len(offs) - 1:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def own_counts(parts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words of slices (batch, texts, whether each document trains), sorted, and their training counts."""
    found = []
    for _, t, train in parts:
        h, back = np.unique(t.word_hashes(), return_inverse=True)
        found.append((h, np.bincount(back, train[t.doc_of_word()], len(h)).astype(np.int64)))
    h, back = np.unique(np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.uint64), return_inverse=True)
    return h, np.bincount(back, np.concatenate([x[1] for x in found]) if found else None, len(h)).astype(np.int64)


def chunked(docs: DataFrame) -> DataFrame:
    """(chunk, doc_id, train, text, words, counts): documents in chunks; the first row of a chunk has the hashes of
    its distinct words and how often its training documents hold each."""

    def run(batch):
        from pyspark import TaskContext

        state["batch"] = state.get("batch", 0) + 1
        lo = 0
        texts = batch.column(1)
        ends = np.cumsum(np.array([len(x.as_buffer()) if x.is_valid else 0 for x in texts], np.int64))
        part = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK_BYTES, "right")))
            piece = batch.slice(lo, hi - lo)
            train = piece.column(2).to_numpy(zero_copy_only=False)
            h, count = own_counts((piece, t, train[a:b]) for a, b, t in common.slices(piece, lower=True))
            offsets = pa.array(np.append(0, np.full(piece.num_rows, len(h))).astype(np.int32))
            chunk = (TaskContext.get().partitionId() << 32) + state["batch"] * 1000 + part
            yield {"chunk": np.full(piece.num_rows, chunk), "doc_id": piece.column(0), "train": piece.column(2), "text": piece.column(1),
                   "words": pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64))), "counts": pa.ListArray.from_arrays(offsets, pa.array(count))}
            lo, part = hi, part + 1

    state: dict[str, int] = {}
    kind = dict(docs.dtypes)["doc_id"]
    src = docs.select("doc_id", common.text_or_empty().alias("text"), in_training().alias("train"))
    return common.arrow_map(src, run, f"chunk long, doc_id {kind}, train boolean, text string, words array<long>, counts array<long>")


def cells(docs: DataFrame) -> DataFrame:
    """(cell, n): how often training documents have each byte after each context, summed by task."""

    def run(batches):
        total = None
        for batch in batches:
            for _, _, t in common.slices(batch, lower=True):
                data, offs = normalized(t)
                rows, _ = contexts(data, offs)
                total = np.zeros(int(_BASE[-1]) * 256, np.int32) if total is None else total
                for k in range(len(TABLES)):
                    np.add.at(total, rows[:, k].astype(np.int64) * 256 + data, np.int32(1))
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["cell", "n"])

    src = docs.where(in_training()).select(common.text_or_empty().alias("text"))
    return src.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame) -> Mixer:
    """Tables over all training documents; starting weights from a bounded number of them."""
    counted = common.scratch_table(cells(docs), "lm-cells")
    # every byte is in the first table once; 256 rows come back
    byte_counts = np.zeros(256)
    for r in counted.where(F.col("cell") < int(_BASE[1]) * 256).groupBy((F.col("cell") % 256).alias("byte")).agg(F.sum("n").alias("n")).collect():
        byte_counts[r["byte"]] = r["n"]
    code = Code(byte_counts)
    rows = 1 << 11

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        counts = np.zeros(rows * 256)
        counts[pdf["cell"].to_numpy() - block * rows * 256] = pdf["n"]
        odds = code.log_odds(counts.reshape(rows, 256))
        return pd.DataFrame({"block": [block], "odds": [odds.tobytes()]})

    # a block has 524,288 cells at most, and there are 18 blocks, whatever the corpus
    made = counted.withColumn("block", F.floor(F.col("cell") / (rows * 256))).groupBy("block").applyInPandas(table, "block long, odds binary")
    odds = np.zeros(-(-int(_BASE[-1]) // rows) * rows * 256, np.int8)
    for r in made.collect():
        part = np.frombuffer(r["odds"], np.int8)
        odds[r["block"] * len(part): (r["block"] + 1) * len(part)] = part
    mixer = Mixer(code, odds, np.full((GATES, len(TABLES)), 0.3 / 16))
    for _ in range(ROUNDS):
        mixer.weights = stepped(mixer.weights, total_slopes(docs, mixer))
    mixer.weights = mixer.weights.astype(np.float32)
    return mixer


def total_slopes(docs: DataFrame, mixer: Mixer) -> np.ndarray:
    """The slopes over all training documents."""
    n = GATES * (len(TABLES) + len(TABLES) ** 2)
    shared = docs.sparkSession.sparkContext.broadcast((mixer.code, mixer.table, mixer.weights))

    def run(batches):
        m = Mixer(*shared.value)
        total, tally = np.zeros(n), Tally()
        for batch in batches:
            for _, _, t in common.slices(batch, lower=True):
                data, offs = normalized(t)
                tally.add(keyed(data, *contexts(data, offs)))
                if len(tally.keys) > HELD:
                    total, tally = total + m.slopes(tally.keys, tally.times).ravel(), Tally()
        total += m.slopes(tally.keys, tally.times).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(total)], names=["cell", "x"])

    src = docs.where(in_training()).select(common.text_or_empty().alias("text"))
    out = np.zeros(n)
    for r in src.mapInArrow(run, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect():
        out[r["cell"]] = r["x"]
    return out.reshape(GATES, -1)


def stepped(weights: np.ndarray, slopes: np.ndarray) -> np.ndarray:
    """weights after a Newton step for each gate; rounded, so that the order of Spark's sums does not show."""
    n = len(TABLES)
    step = [np.linalg.solve(x[n:].reshape(n, n) + np.eye(n), x[:n]) for x in slopes]
    return np.round(weights + step, 7)


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte of every row."""
    spark = docs.sparkSession
    mixer = learn(docs)
    common.release_shuffles(spark)
    shared = spark.sparkContext.broadcast((mixer.code, mixer.table, mixer.weights))
    parts = common.scratch_table(chunked(docs), "lm-chunks", "zstd")
    asked = parts.select("chunk", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("chunk", F.col("w.words").alias("word"), F.col("w.counts").alias("own"))
    total = common.scratch_table(asked.groupBy("word").agg(F.sum("own").alias("c")).where("c > 0"), "lm-words")
    common.release_shuffles(spark)
    # a chunk counts its own words; it needs to hear of those that other chunks hold as well
    answers = common.scratch_table(asked.join(total, "word").where("c <> own").select("chunk", "word", "c"), "lm-answers")
    common.release_shuffles(spark)
    ends = parts.agg(F.count_if("train").alias("ends")).first()["ends"]
    vocabulary = total.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n = (vocabulary["n"] or 0) + ends
    v = vocabulary["v"] + (ends > 0)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    arrow = pa.schema([("doc_id", pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()), ("held_out", pa.bool_()),
                       *((c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64()),
                       ("n_bytes", pa.int64()), ("bits_per_byte", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        m = Mixer(*shared.value)
        words, counts = right.column("word").to_numpy().view(np.uint64), right.column("c").to_numpy()
        order = np.argsort(words)
        words, counts = words[order], counts[order]
        batches = left.select(["doc_id", "train", "text"]).to_batches()
        hashes, own = own_counts((b, t, b.slice(lo, hi - lo).column(1).to_numpy(zero_copy_only=False)) for b in batches for lo, hi, t in common.slices(b, lower=True))
        if len(words):
            at = np.searchsorted(hashes, words)
            own[at] = counts
        out = []
        for batch in batches:
            for lo, hi, t in common.slices(batch, lower=True):
                part = batch.slice(lo, hi - lo)
                c = own[np.searchsorted(hashes, t.word_hashes())] if len(t.starts) else np.zeros(0, np.int64)
                log = np.zeros(len(c) + 1)
                np.cumsum(np.log10((c + 0.5) / (n + 0.5 * (v + 1))), out=log[1:])
                base = log[t.first[1:]] - log[t.first[:-1]] + np.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
                data, offs = normalized(t)
                bits = m.cost(data, offs)
                size = np.diff(offs)
                out.append(pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(~part.column(1).to_numpy(zero_copy_only=False)), pa.array(t.n_words + 1),
                    pa.array(common.sum_by_doc(c > 0, t.first) + int(ends > 0)), pa.array(np.full(t.n, n)), pa.array(base),
                    pa.array(-bits * np.log10(2)), pa.array(size), pa.array(bits / size)], schema=arrow))
        return pa.Table.from_batches(out, schema=arrow)

    # the counts that a chunk asked for; a chunk without words asks for none
    left = parts.select("chunk", "doc_id", "train", "text").groupBy("chunk")
    return left.cogroup(answers.select("chunk", "word", "c").groupBy("chunk")).applyInArrow(run, schema)


def op6_lm_score(spark, sf_dir: str) -> DataFrame:
    """Word and context-mixing log-probabilities of every document."""
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
