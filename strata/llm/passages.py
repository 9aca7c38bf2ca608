"""Repeated passages: the part that word and byte dedup share.

A passage is WINDOW units (words or bytes).  Every window has an anchor, the
smallest hash among the K-unit grams inside it.  Equal windows have equal
anchors, so windows meet in the group of their anchor, and consecutive windows
of one anchor travel together as one segment of text.  An anchor that occurs
only once is dropped before any text moves.

    anchor_table    every document's anchors; about 2 / (WINDOW - K) of its units
    recurring       the anchors that occur often enough, summed before the shuffle
    segments        the windows of recurring anchors, as text, dealt to tasks by anchor
    spans           what a solver, task by task, finds to remove, by document

An anchor of more than TASK_SEGMENTS occurrences is salted over several tasks.
A solver settles what it can inside its task and names each open window by 128
bits; these few rows are settled by one more aggregation over all tasks.
Memory of a task depends on BLOCK_BYTES and TASK_SEGMENTS only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strata.llm import common

TASK_SEGMENTS = 20_000
BLOCK_BYTES = 4 << 20
#: low end of a span that is a whole document
WHOLE = -1
#: windows of one segment, at most (a text of one repeated character is a single run)
SEGMENT_WINDOWS = 4096


def sliding(op: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """op.reduce(values[i:i + width]) for every i that has a full window."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    pad = -len(values) % width
    rows = np.concatenate([values, np.repeat(values[-1:], pad)]).reshape(-1, width)
    ahead = op.accumulate(rows, axis=1).ravel()
    behind = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[:n], ahead[width - 1: width - 1 + n])


class Anchors:
    """Anchors of the windows of a slice.  grams: hash of the k units at each unit; first: units of each document."""

    def __init__(self, grams: np.ndarray, first: np.ndarray, window: int, k: int):
        self.first, self.window = first, window
        units = np.diff(first)
        counts = np.maximum(units - window + 1, 0)
        #: unit at which each window starts, and its document
        self.at = common.ranges(first[:-1], counts)
        self.doc = np.repeat(np.arange(len(units)), counts)
        self.width = window - k + 1
        self.grams = grams | np.uint64(1)  # never 0, which marks starts without a window
        low = sliding(np.minimum, self.grams, self.width)
        self.value = low[self.at]
        self.low = low

    def chosen(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and document of every gram that is the anchor of some window."""
        if not len(self.at):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        low = np.zeros(len(self.grams) + self.width - 1, np.uint64)
        low[self.at + self.width - 1] = self.value
        top = sliding(np.maximum, low, self.width)[: len(self.grams)]
        p = np.flatnonzero(self.grams == top)
        return self.grams[p], np.searchsorted(self.first, p, "right") - 1

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, first unit, number of windows and anchor of each run of windows of one anchor."""
        if not len(self.at):
            none = np.zeros(0, np.int64)
            return none, none, none, np.zeros(0, np.uint64)
        new = np.ones(len(self.at), bool)
        new[1:] = (self.value[1:] != self.value[:-1]) | (self.doc[1:] != self.doc[:-1])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(self.at)))
        # long runs are cut; their pieces overlap in text, not in windows
        pieces = -(-count // SEGMENT_WINDOWS)
        step = common.ranges(np.zeros(len(begin), np.int64), pieces) * SEGMENT_WINDOWS
        begin, count = np.repeat(begin, pieces) + step, np.minimum(np.repeat(count, pieces) - step, SEGMENT_WINDOWS)
        return self.doc[begin], self.at[begin], count, self.value[begin]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a hash of the text that tells rows of one id apart."""
    return docs.select("doc_id", common.text_or_empty().alias("text")).withColumn("version", F.xxhash64("text"))


def same_document(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.version") == F.col(f"{b}.version"))


def anchor_table(docs: DataFrame, anchors: Callable[[common.Texts], Anchors]) -> DataFrame:
    """doc_id, version, and the distinct anchors of each row with their counts."""

    def run(batch):
        for lo, hi, t in common.slices(batch):
            value, doc = anchors(t).chosen()
            order = np.lexsort((value, doc))
            value, doc = value[order], doc[order]
            new = np.ones(len(value), bool)
            new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
            begin = np.flatnonzero(new)
            count = np.diff(np.append(begin, len(value)))
            offsets = pa.array(np.searchsorted(doc[begin], np.arange(t.n + 1)).astype(np.int32))
            part = batch.slice(lo, hi - lo)
            yield {"doc_id": part.column(0), "version": part.column(2),
                   "anchors": pa.ListArray.from_arrays(offsets, pa.array(value[begin].view(np.int64))),
                   "counts": pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int32)))}

    kind = dict(docs.dtypes)["doc_id"]
    return common.arrow_map(keyed(docs), run, f"doc_id {kind}, version long, anchors array<long>, counts array<int>")


def recurring(table: DataFrame, enough: Column) -> DataFrame:
    """(anchor, salts) of the anchors for which `enough` holds of n, low and high: their count, least and largest document."""
    each = table.select("doc_id", F.explode(F.arrays_zip("anchors", "counts")).alias("a")).select("doc_id", "a.anchors", "a.counts")
    sums = each.groupBy(F.col("anchors").alias("anchor")).agg(F.sum("counts").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    return sums.where(enough).select("anchor", F.ceil(F.col("n") / TASK_SEGMENTS).cast("int").alias("salts"))


def segments(docs: DataFrame, table: DataFrame, shared: DataFrame, anchors: Callable[[common.Texts], Anchors],
             cut: Callable[[common.Texts, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(anchor, salt, s1, s2, doc_id, version, start, windows, body): the windows of recurring anchors.

    cut gives the bytes from a unit through the last of a run's windows.  s1, s2 name the
    body; a body that a batch has sent before is null."""
    own = (table.select("doc_id", "version", F.explode("anchors").alias("anchor")).join(shared, "anchor")
           .groupBy("doc_id", "version").agg(F.collect_list(F.struct("anchor", "salts")).alias("mine")))
    own = common.scratch_table(own, "passage-anchors")
    common.release_shuffles(docs.sparkSession)

    def run(batch):
        mine = batch.column(3)
        values = mine.flatten()
        listed = values.field(0).to_numpy(zero_copy_only=False).view(np.uint64)
        listed, back = np.unique(listed, return_index=True)
        salts = values.field(1).to_numpy(zero_copy_only=False)[back].astype(np.int64)
        sent: set[tuple[int, int]] = set()
        for lo, hi, t in common.slices(batch):
            part = batch.slice(lo, hi - lo)
            doc, start, count, value = anchors(t).runs()
            i = np.minimum(np.searchsorted(listed, value), len(listed) - 1)
            hit = np.flatnonzero(listed[i] == value)
            doc, start, count, value, n = doc[hit], start[hit], count[hit], value[hit], salts[i[hit]]
            a, b = cut(t, start, count)
            prefix = common.prefix_hashes(t.data)
            s1 = common.span_hashes(prefix, a, b)
            s2 = common.mix(common.span_hashes(prefix, a + 7, b - 7) ^ s1)
            version = part.column(2).to_numpy()[doc]
            salt = (common.mix(version.view(np.uint64) + np.uint64(1)) % n.astype(np.uint64)).astype(np.int32)
            body = []
            data = t.data.tobytes()
            for x in zip(s1.tolist(), s2.tolist(), salt.tolist(), a.tolist(), b.tolist(), strict=True):
                new = x[:3] not in sent
                body.append(data[x[3]: x[4]] if new else None)
                sent.add(x[:3])
            yield {"anchor": value.view(np.int64), "salt": salt, "s1": s1.view(np.int64), "s2": s2.view(np.int64), "doc_id": part.column(0).take(pa.array(doc)),
                   "version": version, "start": start - t.first_unit[doc], "windows": count, "salted": n > 1, "body": pa.array(body, pa.binary())}

    kind = dict(docs.dtypes)["doc_id"]
    texts = keyed(docs).alias("d").join(own.alias("o"), same_document("d", "o")).select("d.doc_id", "d.text", "d.version", "o.mine")
    return common.arrow_map(texts, run, f"anchor long, salt int, s1 long, s2 long, doc_id {kind}, version long, start long, windows long, salted boolean, body binary")


class Block:
    """Whole (anchor, salt) groups.  bodies: distinct bodies; of: body of each occurrence."""

    def __init__(self, rows: dict[str, np.ndarray], bodies: list[bytes]):
        self.rows, self.bodies = rows, bodies
        self.of, self.doc, self.start, self.windows, self.salted = (rows[c] for c in ("of", "doc_id", "start", "windows", "salted"))
        #: windows of each body
        self.n = np.zeros(len(bodies), np.int64)
        self.n[self.of] = self.windows


#: an occurrence's index, the range of its windows, and the names of open windows (0, 0 for settled ranges)
Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Rows sorted by anchor, salt and body name, as blocks of about BLOCK_BYTES: distinct bodies, rows and the
    windows of all rows, which solve lists one by one."""
    names = ("doc_id", "version", "start", "windows", "salted")
    rows: dict[str, list[np.ndarray]] = {c: [] for c in (*names, "of", "group")}
    bodies: list[bytes] = []
    size, last = 0, None

    def take(upto: int) -> Block:
        """The first upto rows, which end a group; the rest stays."""
        nonlocal bodies, size
        whole = {c: np.concatenate(v) for c, v in rows.items()}
        n = int(whole["of"][upto - 1]) + 1
        block = Block({c: v[:upto] for c, v in whole.items()}, bodies[:n])
        for c, v in whole.items():
            rows[c] = [v[upto:] - n if c == "of" else v[upto:]]
        bodies = bodies[n:]
        size = sum(map(len, bodies)) + 32 * len(rows["of"][0]) + int(rows["windows"][0].sum())
        return block

    n_groups = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("anchor", "salt", "s1", "s2")], 1)
        before = np.concatenate([key[:1] if last is None else last, key[:-1]])
        group = (key[:, :2] != before[:, :2]).any(1)
        name = group | (key[:, 2:] != before[:, 2:]).any(1)
        if last is None:
            group[0] = name[0] = True
        last = key[-1:]
        known = len(bodies)
        of = known - 1 + np.cumsum(name)
        bodies += [b""] * (int(of[-1]) + 1 - known)
        column = batch.column(batch.schema.get_field_index("body"))
        sent = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        new, first = np.unique(of[sent], return_index=True)
        for i, body in zip(new.tolist(), column.take(pa.array(sent[first])).to_pylist(), strict=True):
            if not bodies[i]:
                bodies[i] = body
                size += len(body)
        for c in names:
            rows[c].append(batch.column(c).to_numpy(zero_copy_only=False))
        size += 32 * len(of) + int(rows["windows"][-1].sum())
        rows["of"].append(of)
        rows["group"].append(n_groups + np.cumsum(group))
        n_groups = int(rows["group"][-1][-1])
        if size > BLOCK_BYTES:
            groups = np.concatenate(rows["group"])
            ends = int(np.searchsorted(groups, groups[-1]))  # the last group may go on
            if ends:
                yield take(ends)
    if bodies:
        yield take(sum(map(len, rows["of"])))


def spans(dealt: DataFrame, solve: Callable[[Block], Found], window: int, settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, version, spans): unit ranges to remove, one row for each document that has any.

    settle takes the open rows (doc_id, version, low, high, w1, w2) and returns those that are to be removed."""
    kind = dict(dealt.dtypes)["doc_id"]
    schema = pa.schema([("doc_id", pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()),
                        *((c, pa.int64()) for c in ("version", "low", "high", "w1", "w2"))])

    def run(batches):
        for block in blocks(batches):
            row, low, high, w1, w2 = solve(block)
            ids = block.doc[row]
            cols = [pa.array([None if x != x else x for x in ids.tolist()], schema.field(0).type), block.rows["version"][row], block.start[row] + low, block.start[row] + high + window - 1,
                    w1.view(np.int64), w2.view(np.int64)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in cols], schema=schema)

    rows = dealt.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "s1", "s2")
    out = common.scratch_table(rows.mapInArrow(run, f"doc_id {kind}, version long, low long, high long, w1 long, w2 long"), "passage-spans")
    known = out.where("w1 = 0 and w2 = 0").select("doc_id", "version", "low", "high")
    late = settle(out.where("w1 <> 0 or w2 <> 0")).select("doc_id", "version", "low", "high")
    return known.union(late).groupBy("doc_id", "version").agg(F.collect_list(F.struct("low", "high")).alias("spans"))


def with_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text and spans (null if none) of every row of docs."""
    return keyed(docs).alias("d").join(found.alias("f"), same_document("d", "f"), "left").select("d.doc_id", "d.text", "f.spans")


def removed(column: pa.Array, first: np.ndarray, window: int = 1) -> np.ndarray:
    """Mask of the units of a slice that a spans column covers.  first: units of each document.
    A span from WHOLE on is the whole document, if that has a window."""
    counts = np.array([len(x) if x.is_valid else 0 for x in column], np.int64) if column.null_count else np.diff(column.offsets.to_numpy())
    flat = column.flatten()
    change = np.zeros(int(first[-1]) + 1, np.int64)
    base, units = np.repeat(first[:-1], counts), np.repeat(np.diff(first), counts)
    low, high = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    whole = low == WHOLE
    low, high = np.where(whole, 0, low), np.where(whole, units - 1, high)
    ok = ~whole | (units >= window)
    np.add.at(change, (base + low)[ok], 1)
    np.add.at(change, (base + high)[ok] + 1, -1)
    return np.cumsum(change[:-1]) > 0


def ranges_of(mask: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, first and last index (inside the array) of every run of true values of one group."""
    edge = np.ones(len(mask), bool)
    edge[1:] = (mask[1:] != mask[:-1]) | (group[1:] != group[:-1])
    begin = np.flatnonzero(edge)
    end = np.append(begin[1:], len(mask)) - 1
    keep = mask[begin]
    return group[begin[keep]], begin[keep], end[keep]
