"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so their Jaccard similarity is low
even when an item is contained whole.  The search therefore asks for the share
of the ITEM's shingles that a document holds.  Items are partitioned by their
number of shingles.  An item of a partition that reaches up to u shingles keeps
the floor((1 - t) u) + 1 smallest hashes of its shingles, its MinHash sketch: a
document that holds a share t or more of the item misses too few to miss them
all.  Documents probe the sketches with the part of their shingles below the
largest sketch hash; hits are candidates, and candidates are verified by exact
containment of shingles as text.  No leak of t or more can be lost.

Only DataFrame functions run here.  Sketches and candidates are broadcast when
their counted rows stay under BROADCAST_ROWS, and are shuffled otherwise.

Words are `[^\\x20\\x09-\\x0D]+`, lower-cased.  An item of fewer than K words is one
shingle, its whole sequence.  A null or empty item matches nothing; a null or
empty document holds nothing.  Rows that repeat a document or item give one
result row for the id; a document or item without an id is not searched.
Other columns of the inputs are ignored.  Empty inputs: empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from strata.llm import common

K = 5
THRESHOLD_PERCENT = 80
BROADCAST_ROWS = 100_000

SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    # null text: no words
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACES), lambda w: w != "")


def bind(value: Column, then) -> Column:
    """then(value), with value evaluated once: a lambda variable is not inlined."""
    return F.transform(F.array(value), then)[0]


def shingle_texts(seq: Column, k: int) -> Column:
    """The k-word shingles at every position, as text; none if there are fewer words."""
    return bind(seq, lambda w: F.when(F.size(w) >= k, F.transform(
        F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, k), " "))).otherwise(F.array().cast("array<string>")))


def shingle_hashes(seq: Column, k: int) -> Column:
    """The hash of the shingle at every position, made of the hashes of its words."""
    return bind(F.transform(seq, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) >= k, F.transform(
        F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*(h[i + j] for j in range(k))))).otherwise(F.array().cast("array<bigint>")))


def each_length(make, seq: Column, lengths: list[int]) -> Column:
    found = [make(seq, k) for k in lengths]
    return found[0] if len(found) == 1 else F.flatten(F.array(*found))


def item_shingles(benchmark: DataFrame) -> tuple[DataFrame, list[int]]:
    """(item_id, shingle, h, n) for the distinct shingles of every item, and the shingle lengths in use."""
    items = benchmark.where("item_id is not null").select("item_id", words(F.col("text").cast("string")).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("k", F.least(F.size("w"), F.lit(K)))
    lengths = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most K values
    own = {make: reduce(lambda c, k: c.when(F.col("k") == k, make(F.col("w"), k)), lengths[1:], F.when(F.col("k") == lengths[0], make(F.col("w"), lengths[0])))
           for make in (shingle_texts, shingle_hashes)} if lengths else {shingle_texts: F.array().cast("array<string>"), shingle_hashes: F.array().cast("array<bigint>")}
    # both arrays are in the order of positions, so each text meets its own hash
    pairs = items.select("item_id", F.explode(F.arrays_zip(own[shingle_texts].alias("shingle"), own[shingle_hashes].alias("h"))).alias("p"))
    pairs = pairs.select("item_id", "p.shingle", "p.h").distinct()
    sizes = pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(sizes, "item_id"), lengths


def sketches(shingles: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """(item_id, h): each item's smallest hashes, as many as its size partition asks for."""
    # partitions by size: upper ends 1, 2, 4, 8, ...
    upper = F.pow(F.lit(2), F.ceil(F.log2(F.col("n")))).cast("long")
    size = F.least(F.col("n"), F.floor(F.lit(100 - percent) * upper / 100) + 1)
    by = Window.partitionBy("item_id").orderBy("h")  # a group is one item's shingles
    return (shingles.select("item_id", "h", "n").distinct().withColumn("k", size)
            .withColumn("r", F.row_number().over(by)).where("r <= k").select("item_id", "h"))


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if it has few rows by count; left to a shuffle join otherwise."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contained(docs: DataFrame, benchmark: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) where a document holds percent or more of an item's shingles."""
    shingles, lengths = item_shingles(benchmark)
    shingles = common.scratch_table(shingles, "decontaminate-items")
    n_shingles = shingles.count()
    sketch = common.scratch_table(sketches(shingles, percent), "decontaminate-sketches")
    found = sketch.agg(F.count(F.lit(1)).alias("n"), F.max("h").alias("top")).first()
    kinds = {**dict(docs.dtypes), **dict(benchmark.dtypes)}
    if not found["n"]:
        return docs.sparkSession.createDataFrame([], f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, n_shared long, n_item long")

    rows = docs.where("doc_id is not null").select("doc_id", common.text_or_empty().alias("text"))
    # a row is a document's id and text: rows of one id are searched apart
    keyed = rows.select("doc_id", F.xxhash64("text").alias("version"), words(F.col("text")).alias("w"))
    probes = keyed.select("doc_id", "version", F.explode(each_length(shingle_hashes, F.col("w"), lengths)).alias("h")).where(F.col("h") <= found["top"])
    candidates = common.scratch_table(
        probes.join(small(sketch, found["n"]), "h").select("doc_id", "version", "item_id").distinct()
        .groupBy("doc_id", "version").agg(F.collect_set("item_id").alias("items")), "decontaminate-candidates")
    n_candidates = candidates.count()

    held = (rows.withColumn("version", F.xxhash64("text")).join(small(candidates, n_candidates), ["doc_id", "version"])
            .select("doc_id", "version", "items", F.explode(F.array_distinct(each_length(shingle_texts, words(F.col("text")), lengths))).alias("shingle")))
    exact = shingles.select("item_id", "shingle", "n").distinct()
    shared = (held.join(small(exact, n_shingles), "shingle").where(F.array_contains("items", F.col("item_id")))
              .groupBy("doc_id", "version", "item_id", "n").agg(F.count_distinct("shingle").alias("n_shared")))
    return (shared.where(F.col("n_shared") * 100 >= F.col("n") * percent)
            .groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n").alias("n_item")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """The rows of docs whose document holds no item; rows without an id stay."""
    leaked = common.scratch_table(contained(docs, benchmark, percent).select("doc_id").distinct(), "decontaminate-leaked")
    return docs.join(small(leaked, leaked.count()), "doc_id", "left_anti").select(*docs.columns)


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the shared and total shingles of the item."""
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP10_SQL = """
WITH dw AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL),
iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
it AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS s
  FROM iw WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n FROM it GROUP BY item_id),
ds AS (
  SELECT DISTINCT doc_id, text, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM dw, (SELECT DISTINCT k FROM it) WHERE len(w) >= k),
m AS (SELECT doc_id, text, item_id, count(DISTINCT s) AS n_shared FROM ds JOIN it USING (k, s) GROUP BY doc_id, text, item_id)
SELECT doc_id, item_id, max(n_shared) AS n_shared, max(n) AS n_item FROM m JOIN n USING (item_id)
WHERE 100 * n_shared >= 80 * n GROUP BY doc_id, item_id
"""
