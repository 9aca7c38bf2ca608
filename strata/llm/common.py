"""Helpers shared by the corpus operators.

Texts reach the Python side as Arrow batches.  A batch is cut into slices of a
few MB, and every step works on the slice's UTF-8 buffer as one numpy array:
no per-document Python loop, and memory that depends on the slice only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strata.session import release_shuffles, scratch_path  # noqa: F401

SLICE_BYTES = 2 << 20
WORD = r"[^\x20\x09-\x0D]+"

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_MULT = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def scratch_table(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared checkpoint folder and read it back.

    Cuts the lineage without losing it to a dead executor, and lets one result
    feed several joins without running its Python stage again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 (in place)."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, 0 to n."""
    if len(_powers.get("m", ())) <= n:
        m = max(n + 1, SLICE_BYTES + 1)
        for key, base in (("m", _MULT), ("i", _INVERSE)):
            out = np.full(m, base)
            out[0] = 1
            _powers[key] = np.cumprod(out, dtype=np.uint64)
    return _powers["m"], _powers["i"]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running sums p with p[j] - p[i] = hash of data[i:j], times the i-th power."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts:ends], from prefix_hashes(data)."""
    h = (prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def spans_to(prefix: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """span_hashes of data[starts[i]:i] for every i, whose sizes are known."""
    h = (prefix[:-1] - prefix.take(starts)) * powers(len(prefix))[1].take(starts)
    return mix(h ^ (sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


class Texts:
    """A run of documents as one byte array: document i is data[offs[i]:offs[i + 1]]."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False):
        self.data, self.offs, self.n = (_LOWER[data] if lower else data), offs.astype(np.int64), len(offs) - 1
        size = len(data)
        word = _IS_WORD[data]
        cut = np.zeros(size + 1, bool)
        cut[self.offs] = True
        edge = np.zeros(size + 1, bool)
        edge[1:] = ~word
        edge[0] = True
        self.starts = np.flatnonzero(word & (edge[:size] | cut[:size]))
        edge[:-1] = np.append(~word[1:], True) if size else True
        self.ends = np.flatnonzero(word & (edge[:size] | cut[1:])) + 1
        #: words of document i: first[i] to first[i + 1]
        self.first = np.searchsorted(self.starts, self.offs)
        self.n_words = np.diff(self.first)

    def word_hashes(self) -> np.ndarray:
        return span_hashes(prefix_hashes(self.data), self.starts, self.ends)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    def window_starts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words that begin a k-word window inside one document, and the document of each."""
        counts = np.maximum(self.n_words - k + 1, 0)
        return ranges(self.first[:-1], counts), np.repeat(np.arange(self.n), counts)

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i]: self.offs[i + 1]].tobytes()


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ..., start + count - 1 of every pair, one after the other."""
    total = int(counts.sum())
    out = np.arange(total, dtype=np.int64)
    shift = starts - np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else starts
    return out + np.repeat(shift, counts)


def gram_hashes(h: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[s:s + k] for each s."""
    out = np.zeros(len(starts), np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD1342543DE82EF95) + h[starts + j]
    return mix(out)


def slices(batch: pa.RecordBatch, lower: bool = False, limit: int = SLICE_BYTES, column: str = "text") -> Iterator[tuple[int, int, Texts]]:
    """Cut a batch into runs of whole documents of about `limit` bytes (a longer one is a run of its own)."""
    col = batch.column(batch.schema.get_field_index(column))
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset: col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = col.buffers()[2] if len(col) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, Texts(data[offs[lo]: offs[hi]], offs[lo: hi + 1] - offs[lo], lower)
        lo = hi


def sum_by_doc(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of values[offs[i]:offs[i + 1]]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def seen_before(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key: whether an equal one comes earlier, and how many equal ones there are."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    group = np.cumsum(new) - 1
    earlier, count = np.empty(len(keys), bool), np.empty(len(keys), np.int64)
    earlier[order] = ~new
    count[order] = np.bincount(group, minlength=0)[group] if len(keys) else 0
    return earlier, count


def covered(starts: np.ndarray, length: int, size: int) -> np.ndarray:
    """Boolean mask of 0 .. size - 1 that lies in [s, s + length) for some s."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + length, size), -1)
    return np.cumsum(change[:-1]) > 0


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with a function of one batch that yields dicts of columns."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = StructType.fromDDL(schema)
    out_schema = to_arrow_schema(fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for cols in fn(batch):
                    arrays = [pa.array(cols[f.name], type=f.type) if not isinstance(cols[f.name], pa.Array) else cols[f.name].cast(f.type) for f in out_schema]
                    yield pa.RecordBatch.from_arrays(arrays, schema=out_schema)

    return df.mapInArrow(run, fields)
