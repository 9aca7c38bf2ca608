"""N-gram Jaccard join with signature trees.

Documents are sets of word shingles.  Two documents link when the Jaccard
similarity of their sets reaches a threshold; the result names the connected
group of every document.  No link between different texts is lost:

1.  Equal sets are one node, named by 128 bits of hash.
2.  Nodes are dealt to trees by a lossless key.  Sets of a size class that link
    differ in at most D shingles.  The shingles of a set are cut by hash into
    more than D parts, so two linked sets agree on a whole part.  The hash of a
    part's shingles is a key; linked nodes share one.  (Parts that are empty in
    both sets tell nothing.  A class has spare parts for them, and a set with
    more empty parts than that is cut again by another hash.)  Most nodes that
    share a key only share a passage, and by such keys nearly all documents would
    hang together.  So every node has a sketch, a bitmap with the parity of its
    shingles' hashes: it differs in no more bits than the sets differ in shingles,
    and takes about a bit a shingle.  Nodes of a key that sketches let pass, or a
    chain of them, are in a family; only their sets move.
3.  In a family, a signature tree: every leaf is a set with a bitmap of its
    shingles' hashes, every inner node the OR of its children's bitmaps and the
    range of their sizes.  The tree is traversed against itself, level by level.
    A pair of nodes is dropped when its largest possible overlap
        min(popcount(a & b) + collisions, sizes)
    cannot reach what the threshold asks of the smallest sizes, or when all of
    its sets are in one group already.  Leaf pairs that remain are verified on
    the sets.
4.  A family above TASK_SHINGLES is dealt to blocks by size and hash, and each
    block and pair of blocks of compatible sizes is a task.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z.  A text of fewer words than a
shingle has one shingle, the whole sequence; a null or empty text, or one
without words, has none and is linked with nothing.  Rows that repeat a
document are one node.  A row without an id takes part under the ids of the
others and has no group if there is none.  Other columns of the input are
ignored.  Empty input: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strata.llm import common
from strata.llm.components import components
from strata.session import drop_path, scratch_path

WORDS, PERCENT = 3, 90
#: growth of the upper size from class to class
CLASS_RATIO = 1.5
#: hash functions tried for sets with too many empty parts
SEEDS = 4
#: shingles of a family that one task takes, and of two blocks of a larger one, whose sets have nearly one size
TASK_SHINGLES, BLOCK_SHINGLES = 2_000_000, 8_000_000
#: rows up to which a counted table is broadcast
BROADCAST_ROWS = 300_000
#: keys (two numbers each) up to which they are
BROADCAST_KEYS = 1_000_000
#: bits of a sketch for each shingle in which linked sets may differ, at least
SKETCH_BITS = 3.4
#: nodes of one key that a task compares by their sketches; more are dealt to pairs of blocks
KEY_NODES = 4096
#: bytes of sketches that are compared at a time: memory only
COMPARED = 4 << 20
FANOUT = 8
#: pairs of tree nodes whose children are looked at together: memory only
PAIRS = 2048

_GOLD = 0x9E3779B97F4A7C15


def most_apart(size: int, percent: int) -> int:
    """Largest symmetric difference of linked sets of which the smaller has at most `size` shingles."""
    return (size + size * 100 // percent) * (100 - percent) // (100 + percent)


def size_classes(percent: int, up_to: int) -> list[tuple[int, int, int]]:
    """(upper size, parts, spare parts) of the size classes; sets up to the first upper size link only if equal."""
    top = 1
    while most_apart(top + 1, percent) == 0:
        top += 1
    out = [(top, 0, 0)]
    while top < up_to:
        low, top = top + 1, int(top * CLASS_RATIO) + 1
        apart = most_apart(top, percent)
        # the least number of spare parts that the smallest sets rarely use up; other hashes are tried for those that do
        for spare in range(2 * apart + 4):
            parts = apart + 1 + spare
            if parts * np.exp(-low / parts) <= 0.8 * spare + 0.2:
                break
        out.append((top, parts, spare))
    return out


def shingles(t: common.Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a slice's documents (lower-cased words), and the document of each, in its order."""
    words = t.word_hashes()
    at, doc = t.window_starts(k)
    grams = common.gram_hashes(words, at, k)
    few = np.flatnonzero((t.n_words > 0) & (t.n_words < k))
    if len(few):  # the whole sequence is the only shingle
        own = np.array([common.gram_hashes(words, t.first[i: i + 1], int(t.n_words[i]))[0] for i in few], np.uint64)
        grams, doc = np.concatenate([grams, common.mix(own + t.n_words[few].astype(np.uint64))]), np.concatenate([doc, few])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return grams[new], doc[new]


def set_names(grams: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each document's set."""
    out = []
    for salt in (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0x2545F4914F6CDD1D)):
        total = np.zeros(len(grams) + 1, np.uint64)
        np.cumsum(common.mix(grams ^ salt), out=total[1:])
        first = np.searchsorted(doc, np.arange(n + 1))
        out.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return out[0], out[1]


def part_keys(grams: np.ndarray, doc: np.ndarray, n: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the documents' parts, and the document of each, ordered by document."""
    sizes = np.bincount(doc, minlength=n)
    classes = size_classes(percent, int(sizes.max(initial=1)))
    tops = np.array([c[0] for c in classes])
    own = np.searchsorted(tops, sizes)
    keys, of = [], []
    for c in range(1, len(classes)):
        top, parts, spare = classes[c]
        # sets of the class, and larger ones that can link with a set of it
        pending = (own == c) | ((own == c + 1) & (sizes * percent <= top * 100))
        for seed in range(SEEDS + 1):
            mine = pending[doc]
            if not mine.any():
                break
            d, g = doc[mine], common.mix(grams[mine] ^ np.uint64((seed + 1) * _GOLD % (1 << 64)))
            slot = d * parts + (g % np.uint64(parts)).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            slot, g = slot[order], common.mix(g[order] + _GOLD)
            begin = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
            total = np.add.reduceat(g, begin)
            part, at = slot[begin] % parts, slot[begin] // parts
            tag = np.uint64((c * (SEEDS + 1) + seed) * 1_000_003)
            keys.append(common.mix(total ^ common.mix(part.astype(np.uint64) + tag)))
            of.append(at)
            empty = parts - np.bincount(at, minlength=n)
            pending = pending & (empty > spare)
            if seed == SEEDS - 1 and pending.any():
                # too many empty parts under every hash: the empty parts are keys too
                for i in np.flatnonzero(pending):
                    gone = np.setdiff1d(np.arange(parts), part[at == i]).astype(np.uint64)
                    keys.append(common.mix(gone + tag + np.uint64(_GOLD)))
                    of.append(np.full(len(gone), i))
                break
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, of = np.concatenate(keys), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return keys[order], of[order]


def sketches_of(grams: np.ndarray, doc: np.ndarray, n: int, percent: int) -> pa.Array:
    """Each document's sketch: bit h of 2^b says whether an odd number of its shingles' hashes end in h."""
    need = np.bincount(doc, minlength=n) * (SKETCH_BITS * 2 * (100 - percent) / (100 + percent))
    bits = 64 << np.ceil(np.log2(np.maximum(need / 64, 1))).astype(np.int64)
    start = np.concatenate(([0], np.cumsum(bits)))
    at = (common.mix(grams ^ np.uint64(0xA0761D6478BD642F)) & (bits - 1).astype(np.uint64)[doc]).astype(np.int64) + start[doc]
    odd = (np.bincount(at, minlength=start[-1]) & 1).astype(bool)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((start // 8).astype(np.int32)), pa.py_buffer(np.packbits(odd, bitorder="little"))])


def sketch_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sketches as one array of 64-bit words, the first word of each, and how many it has."""
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offs[0]: offs[-1]].view(np.uint64)
    return data, (offs[:-1] - offs[0]) // 8, np.diff(offs) // 8


def sketch_rows(words, some: np.ndarray, width: int) -> np.ndarray:
    """The sketches `some` as rows of `width` words; longer ones are folded, which keeps the parity of what falls together."""
    data, first, size = words
    out = np.empty((len(some), width), np.uint64)
    for w in np.unique(size[some]):
        mine = np.flatnonzero(size[some] == w)
        rows = data[first[some[mine]][:, None] + np.arange(w)]
        out[mine] = np.bitwise_xor.reduce(rows.reshape(len(mine), w // width, width), axis=1)
    return out


def can_link(a: np.ndarray, b: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of a and b shingles that differ in `differ` at least can link."""
    return (np.minimum(a, b) * 100 >= np.maximum(a, b) * percent) & (differ * (100 + percent) <= (a + b) * (100 - percent))


def likely_pairs(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that their sketches let link."""

    def run(batch):
        a, b = (batch.column(c).to_numpy() for c in ("na", "nb"))
        one, two = sketch_words(batch.column("ka")), sketch_words(batch.column("kb"))
        width = np.minimum(one[2], two[2])
        for w in np.unique(width):
            mine = np.flatnonzero(width == w)
            step = max(1, COMPARED // (8 * int(w)))
            for lo in range(0, len(mine), step):
                i = mine[lo: lo + step]
                differ = np.bitwise_count(sketch_rows(one, i, w) ^ sketch_rows(two, i, w)).sum(1, dtype=np.int64)
                i = i[can_link(a[i], b[i], differ, percent)]
                yield {c: batch.column(c).take(pa.array(i)) for c in ("a", "b")}

    side = lambda x: sketches.select(F.col("s1").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"k{x}"))
    met = pairs.join(side("b"), "b").join(side("a"), "a").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return common.arrow_map(met.select("a", "b", "na", "nb", "ka", "kb"), run, "a long, b long")


def likely_groups(n_shingles: np.ndarray, words, side: np.ndarray, label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of nodes that put those together which their sketches let link, as far as their labels don't.

    side: nodes of equal sides are compared for 2 only, nodes of different ones always."""
    out, label = [], label.copy()
    for width in np.unique(words[2]):
        some = np.flatnonzero(words[2] >= width)
        some = some[np.argsort(n_shingles[some], kind="stable")]
        own = some[words[2][some] == width]
        some = some[n_shingles[some] * percent <= n_shingles[own[-1]] * 100]
        rows, mine, sizes = sketch_rows(words, some, width), sketch_rows(words, own, width), n_shingles[some]
        step = max(1, COMPARED // (8 * int(width) * len(some)))
        for lo in range(0, len(own), step):
            a = own[lo: lo + step]
            # sizes that can link with one of these
            begin, end = np.searchsorted(sizes * 100, n_shingles[a[0]] * percent), np.searchsorted(sizes * percent, n_shingles[a[-1]] * 100, "right")
            b = some[begin:end]
            ok = (label[a][:, None] != label[b][None]) & ((side[a][:, None] != side[b][None]) | (side[a][:, None] == 2))
            i, j = np.nonzero(ok)
            for at in range(0, len(i), max(1, COMPARED // (8 * int(width)))):
                x, y = (v[at: at + max(1, COMPARED // (8 * int(width)))] for v in (i, j))
                differ = np.bitwise_count(mine[lo + x] ^ rows[begin + y]).sum(1, dtype=np.int64)
                keep = can_link(n_shingles[a[x]], n_shingles[b[y]], differ, percent)
                for p, q in zip(a[x[keep]].tolist(), b[y[keep]].tolist(), strict=True):
                    if label[p] != label[q]:
                        label[label == label[q]] = label[p]
                        out.append((p, q))
    return out


def likely_links(batches: Iterator[pa.RecordBatch], percent: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of tasks (key, lo, hi), sorted by task, to edges between nodes that their sketches let link."""

    def solve(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        s1, n, side, label = (t.column(c).to_numpy() for c in ("s1", "n_shingles", "side", "label"))
        found = likely_groups(n, sketch_words(t.column("sketch").combine_chunks()), side, label, percent)
        at = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(s1[at[:, k]]) for k in (0, 1)], schema=schema)

    task, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in ("key", "lo", "hi")]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
            here = tuple(int(c[lo]) for c in cols)
            if here != task and parts:
                yield solve(parts)
                parts = []
            task = here
            parts.append(batch.slice(lo, hi - lo))
    if parts:
        yield solve(parts)


def list_array(values: np.ndarray, of: np.ndarray, n: int) -> pa.Array:
    """Values grouped by document as a list column."""
    offsets = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def described(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, the set's name (s1, s2), its keys and its sketch, for every row."""

    def run(batch):
        for lo, hi, t in common.slices(batch, lower=True):
            grams, doc = shingles(t, k)
            s1, s2 = set_names(grams, doc, t.n)
            keys, of = part_keys(grams, doc, t.n, percent)
            yield {"doc_id": batch.slice(lo, hi - lo).column(0), "n_shingles": np.bincount(doc, minlength=t.n), "s1": s1, "s2": s2,
                   "keys": list_array(keys, of, t.n), "sketch": sketches_of(grams, doc, t.n, percent)}

    kind = dict(docs.dtypes)["doc_id"]
    return common.arrow_map(docs.select("doc_id", common.text_or_empty().alias("text")), run,
                            f"doc_id {kind}, n_shingles long, s1 long, s2 long, keys array<long>, sketch binary")


def families(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(s1, family): nodes that share a key and can link by their sketches, with all that they lead to."""
    spark = rows.sparkSession
    # one row for each set: rows that repeat it give the same keys
    spare = common.scratch_table(rows.select("doc_id", "s1", "s2").join(nodes, ["s1", "s2"]).where("doc_id <> rep").select("doc_id", "s1", "s2").distinct(), "join-spare")
    if spare.count() <= BROADCAST_ROWS:
        spare = F.broadcast(spare)
    keyed = rows.where("n_shingles > 0").join(spare, ["doc_id", "s1", "s2"], "left_anti").select(F.explode("keys").alias("key"), "s1")
    # dealt by key as they are: sums by key in each task would only add columns to rows that hardly ever meet there
    shared = common.scratch_table(
        keyed.repartition("key").groupBy("key").agg(F.min("s1").alias("low"), F.max("s1").alias("high"), F.count(F.lit(1)).alias("rows")).where("low < high"), "join-keys")
    common.release_shuffles(spark)
    # a key of more than two rows has members besides these two
    more = shared.where("rows > 2").select("key", "low")
    if more.count() <= BROADCAST_KEYS:
        more = F.broadcast(more)
    groups = common.scratch_table(keyed.join(more, "key").select("key", "low", "s1").distinct(), "join-shared")
    common.release_shuffles(spark)
    # first every node with the smallest of its keys
    stars = common.scratch_table(shared.select(F.col("low").alias("a"), F.col("high").alias("b")).union(
        groups.select(F.col("low").alias("a"), F.col("s1").alias("b"))).where("a <> b").distinct(), "join-stars")
    met = stars.select(F.col("a").alias("s1")).union(stars.select("b")).distinct()
    sketches = common.scratch_table(rows.where("n_shingles > 0").select("s1", "n_shingles", "sketch").join(met, "s1", "left_semi").distinct(), "join-sketches")
    likely = common.scratch_table(likely_pairs(stars, sketches, percent), "join-likely")
    # then all nodes of the keys whose nodes are not together by that, once for keys of the same nodes
    together = components(likely)
    at = groups.select("key", "s1").join(together.select(F.col("node").alias("s1"), F.col("component").alias("label")), "s1", "left").select(
        "key", "s1", F.coalesce("label", "s1").alias("label"))
    apart = at.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("n"),
                                  *(F.bit_xor(F.xxhash64("s1", F.lit(i))).alias(f"h{i}") for i in (1, 2))).where("least < most AND n > 2")
    apart = common.scratch_table(apart.groupBy("n", "h1", "h2").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / KEY_NODES).cast("int").alias("blocks")), "join-apart")
    apart = F.broadcast(apart) if apart.count() <= BROADCAST_KEYS else apart
    block = F.pmod(F.xxhash64("s1"), F.col("blocks"))
    dealt = at.join(apart, "key").select("key", "s1", "label", block.cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    dealt = dealt.select("key", "s1", "label", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), side.alias("side")).join(sketches, "s1")
    task = ["key", "lo", "hi"]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    dealt = dealt.select(*task, "s1", "n_shingles", "side", "label", "sketch").repartition(*task).sortWithinPartitions(*task)
    others = common.scratch_table(dealt.mapInArrow(lambda it: likely_links(it, percent, schema), "a long, b long"), "join-others")
    return components(likely.union(others)).select(F.col("node").alias("s1"), F.col("component").alias("family"))


class Forest:
    """The sets of a task, in the order of their smallest hashes, with the tree's levels above them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets], np.int64)
        bits = 1 << int(np.clip(np.ceil(np.log2(2 * self.sizes.max())), 8, 16))
        packed = np.empty((len(sets), bits // 64), np.uint64)
        for lo in range(0, len(sets), 64):  # a few unpacked bitmaps at a time
            maps = np.zeros((min(64, len(sets) - lo), bits), bool)
            for i, s in enumerate(sets[lo: lo + 64]):
                maps[i, (s % np.uint64(bits)).astype(np.int64)] = True
            packed[lo: lo + 64] = np.packbits(maps, axis=1).view(np.uint64)
        #: by level, leaves first: bitmaps, least and largest size, and the most shingles that share a bit with another of their set
        self.levels = [(packed, self.sizes, self.sizes, self.sizes - np.bitwise_count(packed).sum(1, dtype=np.int64))]
        while len(self.levels[-1][0]) > 1:
            maps, least, most, extra = self.levels[-1]
            at = np.arange(0, len(maps), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at), np.maximum.reduceat(extra, at)))


def overlap_possible(level, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether some set below i and some set below j can link."""
    maps, least, most, extra = level
    need = -(-percent * (least[i] + least[j]) // (100 + percent))
    near = (most[i] * 100 >= least[j] * percent) & (most[j] * 100 >= least[i] * percent)
    bound = np.minimum(most[i], most[j])
    ok = near & (bound >= need)
    at = np.flatnonzero(ok)
    for lo in range(0, len(at), 4096):
        part = at[lo: lo + 4096]
        common_bits = np.bitwise_count(maps[i[part]] & maps[j[part]]).sum(1, dtype=np.int64)
        ok[part] = common_bits + np.minimum(extra[i[part]], extra[j[part]]) >= need[part]
    return ok


def link_groups(sets: list[np.ndarray], side: np.ndarray, percent: int) -> np.ndarray:
    """Label of the linked group of each set.  side: sets of equal sides are compared for 2 only, sets of different ones always."""
    n = len(sets)
    order = sorted(range(n), key=lambda i: (int(sets[i][0]), len(sets[i])))
    tree = Forest([sets[i] for i in order])
    sets, side = tree.sets, side[order]
    label = np.arange(n)

    def linked(i, j):
        shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared)

    def join(i, j):
        label[label == label[j]] = label[i]

    for i in range(n - 1):  # near copies lie side by side in this order
        if linked(i, i + 1):
            join(i, i + 1)
    i = j = np.zeros(1, np.int64)
    fan = np.arange(FANOUT)
    for depth in range(len(tree.levels) - 1, -1, -1):
        level, at = tree.levels[depth], np.arange(0, n, FANOUT ** depth)
        low, high = np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)
        left = []
        for lo in range(0, len(i), PAIRS):  # so many pairs at a time, with their children
            a, b = i[lo: lo + PAIRS], j[lo: lo + PAIRS]
            if depth < len(tree.levels) - 1:  # children of the pairs that are left
                a = (a[:, None, None] * FANOUT + fan[None, :, None] + 0 * fan).ravel()
                b = (b[:, None, None] * FANOUT + fan[None, None, :] + 0 * fan[None, :, None]).ravel()
                ok = (a <= b) & (b < len(level[0]))
                a, b = a[ok], b[ok]
            one = (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])
            if depth == 0:
                one |= (a == b) | ((side[a] != 2) & (side[a] == side[b]))
            keep = np.flatnonzero(~one)
            keep = keep[overlap_possible(level, a[keep], b[keep], percent)]
            left.append((a[keep], b[keep]))
        i, j = (np.concatenate([x[k] for x in left]) if left else np.zeros(0, np.int64) for k in (0, 1))
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        if label[x] != label[y] and linked(x, y):
            join(x, y)
    out = np.empty(n, np.int64)
    out[order] = label
    return out


def links(batches: Iterator[pa.RecordBatch], percent: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of tasks, sorted by task, to edges between the members of a group."""

    def solve(rows):
        ids, sides, sets = zip(*rows, strict=True)
        label = link_groups([np.frombuffer(s, np.uint64) for s in sets], np.array(sides), percent)
        head: dict[int, int] = {}
        for doc, x in sorted(zip(ids, label.tolist(), strict=True)):
            if head.setdefault(x, doc) != doc:
                yield head[x], doc

    task, rows, edges = None, [], []
    for batch in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):  # few sets as Python objects besides the task's
        for key, doc, side, data in zip(*(batch.column(c).to_pylist() for c in ("task", "rep", "side", "grams")), strict=True):
            if key != task:
                if len(rows) > 1:
                    edges += solve(rows)
                task, rows = key, []
            rows.append((doc, side, data))
        if len(edges) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], schema.field(i).type) for i in (0, 1)], schema=schema)
            edges = []
    if len(rows) > 1:
        edges += solve(rows)
    if edges:
        yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], schema.field(i).type) for i in (0, 1)], schema=schema)


def family_sets(docs: DataFrame, members: DataFrame, repeated: DataFrame, k: int) -> DataFrame:
    """members (rep, s1, s2, ...) with the shingles of each set, from the text of its representative.

    repeated (rep, s1, s2): sets that several rows of the representative's id have; only these can
    come twice, and only they are made distinct, so the others' shingles are not shuffled for it."""
    extra = [c for c in members.columns if c not in ("rep", "s1", "s2")]

    def run(batch):
        for lo, hi, t in common.slices(batch, lower=True):
            part = batch.slice(lo, hi - lo)
            grams, doc = shingles(t, k)
            a, b = set_names(grams, doc, t.n)
            cut = np.searchsorted(doc, np.arange(t.n + 1))
            # another row of the same id may have another text
            own = (a == part.column("s1").to_numpy()) & (b == part.column("s2").to_numpy())
            part = part.filter(pa.array(own))
            yield {**{c: part.column(c) for c in ("rep", "s1", "s2", *extra)}, "grams": [grams[cut[i]: cut[i + 1]].tobytes() for i in np.flatnonzero(own)]}

    kinds = dict(members.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("rep", "s1", "s2", *extra)) + ", grams binary"

    def read(some):
        wanted = some if some.count() > BROADCAST_ROWS else F.broadcast(some)
        texts = docs.select(F.col("doc_id").alias("rep"), common.text_or_empty().alias("text")).join(wanted, "rep")
        return common.arrow_map(texts.select("rep", "text", "s1", "s2", *extra), run, schema)

    if repeated.isEmpty():
        return read(members)
    key = ["rep", "s1", "s2"]
    twice = read(members.join(repeated, key, "left_semi")).dropDuplicates(key)
    return read(members.join(repeated, key, "left_anti")).unionByName(twice)


def size_bucket(percent: int):
    """(bucket of n_shingles, whether a set can link with one of the bucket below).

    A bucket spans two steps of the largest ratio of linked sizes, so a set links within its
    bucket or a neighbour, and only the lower half of a bucket reaches the one below."""
    ratio = (100 / percent) ** 2
    bucket = F.floor(F.log("n_shingles") / F.log(F.lit(ratio)) + F.lit(1e-9))
    return bucket, F.col("n_shingles") * percent / 100 <= F.pow(F.lit(ratio), bucket) * (1 + 1e-6) + 1e-6


def dealt_tasks(members: DataFrame) -> DataFrame:
    """members with tasks, an array of (task, side): a family is a task, or it is cut into blocks by size and
    hash, with a task for each block and each pair of blocks that can link.

    Dealt before the sets are read, so that their shingles move once to each of their tasks.  Sets of the
    bucket above that reach down join the tasks of single blocks if they fill one block at most."""
    bucket = F.col("bucket")
    blocks = members.groupBy("family", "bucket").agg(F.sum("n_shingles").alias("load"))
    whole = blocks.groupBy("family").agg(F.sum("load").alias("load")).select("family", (F.col("load") > TASK_SHINGLES).alias("split"))
    blocks = blocks.select("family", "bucket", F.ceil(F.col("load") * 2 / BLOCK_SHINGLES).cast("int").alias("salts"))
    above = blocks.select("family", (bucket - 1).alias("bucket"), F.col("salts").alias("above"))
    below = blocks.select("family", (bucket + 1).alias("bucket"), F.col("salts").alias("below"))
    plan = blocks.join(above, ["family", "bucket"], "left").join(below, ["family", "bucket"], "left").join(whole, "family")
    rows = members.join(plan, ["family", "bucket"])
    salt = F.pmod(F.xxhash64("s1", "s2"), F.col("salts"))

    def task(low, high, a, b):
        return F.concat_ws("/", F.col("family").cast("string"), *(x.cast("string") for x in (low, high, a, b)))

    def each(n, make):
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), make)).otherwise(F.array().cast("array<struct<task:string,side:int>>"))

    own = each(F.col("salts"), lambda s: F.struct(
        task(bucket, bucket, F.least(s, salt), F.greatest(s, salt)).alias("task"),
        F.when(s == salt, 2).when(salt < s, 0).otherwise(1).alias("side")))
    # side 3: compared with the task's own block only
    up = each(F.when(F.col("above") > 1, F.col("above")).otherwise(0), lambda s: F.struct(task(bucket, bucket + 1, salt, s).alias("task"), F.lit(0).alias("side")))
    down = each(F.when(F.col("reaches"), F.coalesce("below", F.lit(0))).otherwise(0), lambda s: F.when(
        F.col("salts") > 1, F.struct(task(bucket - 1, bucket, s, salt).alias("task"), F.lit(1).alias("side"))).otherwise(
        F.struct(task(bucket - 1, bucket - 1, s, s).alias("task"), F.lit(3).alias("side"))))
    single = F.array(F.struct(F.col("family").cast("string").alias("task"), F.lit(2).alias("side")))
    return rows.select("rep", "s1", "s2", F.when(F.col("split"), F.concat(own, up, down)).otherwise(single).alias("tasks"))


def jaccard_join(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    keyed = scratch_path(spark, "join-keyed")
    full = described(docs, k, percent)
    full.write.parquet(keyed)
    full = spark.read.schema(full.schema).parquet(keyed)
    rows = common.scratch_table(full.drop("keys", "sketch"), "join-rows")
    nodes = rows.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"))
    family = common.scratch_table(families(full, nodes, percent), "join-families")
    drop_path(spark, keyed)  # the keys are the largest table, and have done their work
    bucket, reaches = size_bucket(percent)
    members = nodes.where("rep is not null").join(family, "s1").select("rep", "s1", "s2", "n_shingles", "family", bucket.alias("bucket"), reaches.alias("reaches"))
    members = common.scratch_table(members, "join-members")
    repeated = common.scratch_table(rows.select(F.col("doc_id").alias("rep"), "s1", "s2").join(members.select("rep", "s1", "s2"), ["rep", "s1", "s2"], "left_semi")
                                    .groupBy("rep", "s1", "s2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "join-twice")
    tasks = common.scratch_table(dealt_tasks(members), "join-tasks")
    common.release_shuffles(spark)
    sets = family_sets(docs, tasks, repeated, k).select("rep", "grams", F.explode("tasks").alias("t")).select("t.task", "rep", "t.side", "grams")
    tasks = sets.repartition("task").sortWithinPartitions("task")
    schema = pa.schema([(c, pa.int64() if kind == "bigint" else pa.string() if kind == "string" else pa.int32()) for c in ("a", "b")])
    edges = common.scratch_table(tasks.mapInArrow(lambda it: links(it, percent, schema), f"a {kind}, b {kind}"), "join-edges")
    groups = components(edges)
    named = nodes.join(groups, F.col("rep") == F.col("node"), "left").select("s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "s1", "s2").join(named, ["s1", "s2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs with one document of each linked group, that of the smallest id.

    Rows that repeat its id and text go too; rows without an id stay."""
    groups = common.scratch_table(jaccard_join(docs, k, percent), "join-groups")
    drop = common.scratch_table(groups.where("doc_id <> component_id").select("doc_id").distinct(), "join-drop")
    kept = docs.join(F.broadcast(drop) if drop.count() <= BROADCAST_ROWS else drop, "doc_id", "left_anti").select(*docs.columns)
    again = common.scratch_table(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "join-repeated")
    n = again.count()
    if not n:
        return kept
    again = F.broadcast(again) if n <= BROADCAST_ROWS else again
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).union(
        kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Group of documents linked by the Jaccard similarity of their 3-word shingles."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
