"""Vector code compression by limb-split exact matrix products.

Vectors of whole numbers are cut into equal parts; every part is coded by the
index of its nearest codebook entry.  The squared distance to an entry c is
|x|^2 - 2 x.c + |c|^2, so the nearest entry needs one matrix product a part.
Floating-point BLAS is exact only while sums stay below 2^53: both factors are
broken into limbs of few enough bits that every product of two limb matrices
is an exact float64 product, and the limb products are shifted and summed in
64-bit integers.  The first smallest distance is taken, so ties go to the lower
index.

Codebooks start from the parts of the smallest ids and are refined for a few
rounds: each task sums its rows by (part, entry), Spark adds the tasks' sums,
and the driver holds the codebooks only (parts x entries x part length numbers,
whatever the input).  A task keeps one slice of rows at a time.

Null vectors and those with a null, NaN or infinite component are left out.
Vectors of different lengths count as ending in zeros, up to the longest one
rounded up to a multiple of the parts.  Codebooks start from distinct ids, of
equal ids from the smallest vector; rows with a null id are coded but never
start a codebook; fewer ids than entries give fewer entries.  Repeated rows are
coded once each and count as often in sums.  A null label is a label of its own.
If no row has an id, there is nothing to start from and the result is empty, as
for empty input.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strata.llm import common, vectors

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: labels up to which their sums are broadcast; more are joined by a shuffle
BROADCAST_ROWS = 50_000
SLICE_ROWS = 4096


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """float64 matrices with values = sum of the ith times 2^(i * bits): in [0, 2^bits), the last one signed and at most 2^bits."""
    out, rest = [], values
    while np.abs(rest).max(initial=0) > 1 << bits:
        out.append((rest & ((1 << bits) - 1)).astype(np.float64))
        rest = rest >> bits
    return [*out, rest.astype(np.float64)]


def limb_bits(width: int) -> int:
    """Bits of a limb so that sums of `width` products of two limbs (each up to 2^bits) stay below 2^53."""
    return max(1, (52 - max(width, 1).bit_length()) // 2)


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64 matrices, exact if the result fits 64 bits: float64 products of limbs, added up as integers."""
    bits = limb_bits(a.shape[1])
    out = np.zeros((len(a), len(b)), np.int64)
    right = limbs(b, bits)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(right):
            out += (x @ y.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First nearest entry of every row of x, and its squared distance."""
    part = (book * book).sum(1)[None, :] - 2 * exact_product(x, book)
    at = part.argmin(1)
    return at, (x * x).sum(1) + part[np.arange(len(x)), at]


def _split(m: np.ndarray, parts: int) -> np.ndarray:
    """(part, row, component) of a matrix of rows."""
    return np.ascontiguousarray(m.reshape(len(m), parts, m.shape[1] // parts).transpose(1, 0, 2))


def first_books(rows: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    """(part, entry, component): the parts of the rows of the smallest ids; `entries` rows come to the driver."""
    first = rows.where(F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").limit(entries).collect()
    return _split(vectors.matrix([r["v"] for r in first], parts * width), parts)


def refined(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round: entries replaced by the floored means of the parts that are nearest to them."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for x in _slices(batches, parts, width, "v"):
            for p in range(parts):
                at, _ = nearest(x[p], books[p])
                np.add.at(total[p], at, x[p])
                count[p] += np.bincount(at, minlength=entries)
        part, entry = np.nonzero(count)
        if len(part):
            yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": count[part, entry],
                                              "total": pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))})

    found = rows.select("v").mapInArrow(sums, "part int, entry int, n long, total array<long>")
    each = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(width)]
    out = books.copy()
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect():  # parts x entries rows
        out[r["part"], r["entry"]] = [int(r[f"t{i}"]) // r["n"] for i in range(width)]
    return out


def _slices(batches: Iterator[pa.RecordBatch], parts: int, width: int, column: str) -> Iterator[np.ndarray]:
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        for lo in range(0, len(col), SLICE_ROWS):
            yield _split(vectors.matrix(col.slice(lo, SLICE_ROWS), parts * width), parts)


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of rows (vec_id, label, v); two hex digits an index up to 256 entries, else four."""
    parts, entries, width = books.shape
    kind = np.dtype(np.uint8 if entries <= 256 else ">u2")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        codes, error = [], []
        for x in _slices([batch], parts, width, "v"):
            found = [nearest(x[p], books[p]) for p in range(parts)]
            digits = np.stack([at for at, _ in found], 1).astype(kind)
            codes += [row.tobytes().hex() for row in digits]
            error.append(np.sum([far for _, far in found], 0))
        yield {"vec_id": batch.column(0), "label": batch.column(1), "code": codes, "error": np.concatenate(error)}

    kinds = dict(rows.dtypes)
    return common.arrow_map(rows.select("vec_id", "label", "v"), run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal integers joined by commas: by part, entry, place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error) of every vector that takes part, codebooks (part, entry, component))."""
    rows = embeddings.where(vectors.usable(vector)).select("vec_id", "label", vectors.whole(vector).alias("v"))
    rows = common.scratch_table(rows, "codes-rows")
    n, dim, top = vectors.shape(rows)
    width = max(1, -(-dim // parts))
    vectors.within(parts * width, top, 8)
    books = first_books(rows, parts, entries, width)
    if not books.shape[1]:
        return rows.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books
    for _ in range(rounds):
        books = refined(rows, books)
    return coded(rows, books), books


def op12_code_vectors(spark, sf_dir: str) -> DataFrame:
    """Code and error of every vector, the error of its label, and the codebooks' digest."""
    found, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = common.scratch_table(found, "codes")
    by_label = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").cast("long").alias("label_error"))
    if by_label.count() <= BROADCAST_ROWS:
        by_label = F.broadcast(by_label)
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The same in SQL: parts as rows, an assignment and a mean a round."""
    assign = """
a{r} AS MATERIALIZED (
  SELECT rid, part, v, entry, far FROM (
    SELECT x.rid, x.part, x.v, b.entry, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i]))) AS far,
           row_number() OVER (PARTITION BY x.rid, x.part ORDER BY list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i]))), b.entry) AS n
    FROM pieces x JOIN b{r} b ON b.part = x.part) t WHERE n = 1)"""
    mean = """,
sums{r} AS (SELECT part, entry, i, floor_div FROM (
  SELECT a.part, a.entry, u.i, sum(a.v[u.i]) AS s, count(*) AS c,
         CAST(CASE WHEN sum(a.v[u.i]) >= 0 THEN sum(a.v[u.i]) // count(*) ELSE -((-sum(a.v[u.i]) + count(*) - 1) // count(*)) END AS BIGINT) AS floor_div
  FROM a{r} a, (SELECT unnest(range(1, w + 1)) AS i FROM width) u GROUP BY a.part, a.entry, u.i) t),
b{n} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(s.v, b.v) AS v FROM b{r} b
  LEFT JOIN (SELECT part, entry, list(floor_div ORDER BY i) AS v FROM sums{r} GROUP BY part, entry) s ON s.part = b.part AND s.entry = b.entry),"""
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
width AS (SELECT max(len(v)) // {PARTS} AS w FROM kept),
pieces AS MATERIALIZED (
  SELECT rid, vec_id, p AS part, list_slice(v, p * w + 1, p * w + w) AS v FROM kept, width, (SELECT unnest(range(0, {PARTS})) AS p) q),
b0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM pieces
  WHERE vec_id IN (SELECT vec_id FROM kept WHERE vec_id IS NOT NULL ORDER BY vec_id LIMIT {ENTRIES})),""" + assign.format(r=0) + mean.format(r=0, n=1) + assign.format(r=1) + mean.format(r=1, n=2) + assign.format(r=2) + """,
per_row AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a2 GROUP BY rid),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS d FROM b2)
SELECT k.vec_id, r.code, r.error, CAST(sum(r.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, d.d AS codebooks_sha256
FROM kept k JOIN per_row r ON r.rid = k.rid, digest d
"""


OP12_SQL = _sql()
