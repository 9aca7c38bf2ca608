"""Hard negatives, vector codes and sharding against brute force: nulls, odd vectors, ties, repeated rows, empty
tables and extra columns."""
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from strata.llm import code_vectors, hard_negatives, sharding, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, anchor_id long, v string, code string"


def rows_of(n=420, dim=16, seed=3, odd=True):
    """Clustered vectors with exact copies and tied scores; odd: also rows that must not count."""
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 0.3) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = centres[i % 6] if i % 9 else centres[0]
        rows.append((i, [float(np.float32(x + (0 if i % 5 == 0 else rnd.gauss(0, 0.05)))) for x in c], rnd.randrange(4)))
    if odd:
        rows += [(n, None, 1), (n + 1, [1.0] * dim, None), (n + 2, [None] + [0.5] * (dim - 1), 1), (n + 3, [float("nan")] * dim, 2),
                 (n + 4, [float("inf")] + [0.0] * (dim - 1), 2), (None, [0.1] * dim, 1), rows[7], (9, rows[12][1], 0), (n + 5, [], 3), (1000, [0.25, -0.25], 1)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 5, "v", "c") for i, v, label in rows], SCHEMA)


def integers(rows, dim):
    out = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            out.append((i, [math.floor(256 * x) for x in v] + [0] * (dim - len(v)), label))
    return out


def brute_negatives(rows, dim, is_anchor, relabel=lambda i, label: label):
    best = {}
    for i, v, label in integers(rows, dim):
        if i is not None and label is not None:
            best[i] = min(best.get(i, (label, v)), (label, v))
    table = {i: (relabel(i, label), v) for i, (label, v) in best.items()}
    out = set()
    for a, (label, q) in table.items():
        if not is_anchor(a):
            continue
        score = {i: sum(x * y for x, y in zip(q, v)) for i, (_, v) in table.items()}
        order = sorted((i for i in table if i != a), key=lambda i: (-score[i], i))
        for p in [i for i in order if table[i][0] == label][:5]:
            hits = [i for i in order if table[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out |= {(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(hits[:5])}
    return out


@pytest.mark.parametrize("candidates, anchors", [(37, 3), (2048, 512)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, candidates, anchors):
    monkeypatch.setattr(hard_negatives, "CANDIDATES", candidates)
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    rows = rows_of()
    found = hard_negatives.mine(hard_negatives.prepared(frame(spark, rows)), "vec_id % 20 = 0")
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_negatives(rows, 16, lambda i: i % 20 == 0) and len(got) > 50


def test_hard_negatives_of_nothing(spark):
    empty = frame(spark, [])
    assert hard_negatives.mine(hard_negatives.prepared(empty), "vec_id % 20 = 0").count() == 0
    alone = frame(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, None, 1)])  # a positive, no other label
    assert hard_negatives.mine(hard_negatives.prepared(alone), "vec_id = 0").count() == 0


def test_lists_stop_early_and_only_below_the_kth_score():
    rng = np.random.default_rng(0)
    n = 4000
    x = rng.integers(-5, 6, (n, 4))
    x[17] = x[3011] = x[44] = [400, 300, -200, 100]  # far ahead, tied
    lists = hard_negatives.Lists(np.arange(n), np.zeros(n, int), x)
    q = np.array([4, 3, -2, 1])
    ((at, scores),), used = lists.read(q, np.ones(n, bool), [(hard_negatives.LOWEST, hard_negatives.HIGHEST)], 2)
    assert at.tolist() == [17, 44] and scores[0] == scores[1] and used < n / 4
    ((at, _),), used = lists.read(np.zeros(4, int), np.ones(n, bool), [(0, 0)], 3)  # every score is zero
    assert at.tolist() == [0, 1, 2] and used == n
    # a floor above what is left ends the reading, a window without room at once
    (_, none), used = lists.read(q, np.ones(n, bool), [(2000, 2900), (9, 5)], 5)
    assert not len(none[0]) and used < n / 4
    # ties across the end of a stretch: the smaller id is read later but comes first
    tied = np.ones((200, 1), int)
    lists = hard_negatives.Lists(np.arange(200), np.zeros(200, int), tied)
    ((at, _),), used = lists.read(np.array([1]), np.ones(200, bool), [(1, 1)], 3)
    assert at.tolist() == [0, 1, 2] and used == 200


def test_limb_products_are_exact():
    rnd = random.Random(5)
    for width, top in ((4, 1 << 28), (64, 1 << 26), (1, 1 << 30), (7, 3)):
        a = [[rnd.randrange(-top, top + 1) for _ in range(width)] for _ in range(5)] + [[-top] * width, [top] * width, [0] * width]
        want = [[sum(x * y for x, y in zip(r, s)) for s in a] for r in a]
        m = np.array(a, np.int64)
        assert code_vectors.exact_product(m, m).tolist() == want
        bits = code_vectors.limb_bits(width)
        for limb in code_vectors.limbs(m, bits):
            assert np.abs(limb).max() ** 2 * width < 2 ** 53
        assert sum(x.astype(object) * (1 << (bits * i)) for i, x in enumerate(limb.astype(np.int64) for limb in code_vectors.limbs(m, bits))).tolist() == a
    at, far = code_vectors.nearest(np.array([[1, 1]]), np.array([[2, 2], [0, 0], [1, 2]]))
    assert (at[0], far[0]) == (2, 1)
    assert code_vectors.nearest(np.array([[1]]), np.array([[2], [0]]))[0][0] == 0  # a tie goes to the lower index
    with pytest.raises(ValueError):
        vectors.within(64, 1 << 29, 8)


def brute_codes(rows, parts, entries, rounds):
    dim = max((len(v) for _, v, _ in rows if v is not None), default=0)
    width = -(-dim // parts)
    table = integers(rows, parts * width)
    first = {}
    for i, v, _ in table:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    cut = lambda v, p: v[p * width: (p + 1) * width]
    books = [[cut(first[i], p) for i in sorted(first)[:entries]] for p in range(parts)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda x, p: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(rounds):
        sums = collections.defaultdict(list)
        for _, v, _ in table:
            for p in range(parts):
                sums[p, near(cut(v, p), p)].append(cut(v, p))
        for (p, e), xs in sums.items():
            books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for i, v, label in table:
        code = [near(cut(v, p), p) for p in range(parts)]
        out.append((i, label, bytes(code).hex(), sum(far(cut(v, p), books[p][e]) for p, e in enumerate(code))))
    return sorted(out, key=str), hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


def test_codes_equal_brute_force(spark):
    rows = rows_of(n=300, dim=16)
    found, books = code_vectors.compress(frame(spark, rows), parts=4, entries=8)
    want, digest = brute_codes(rows, 4, 8, 2)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want and code_vectors.books_digest(books) == digest
    few = rows[:3]
    found, books = code_vectors.compress(frame(spark, few), parts=16, entries=64)
    assert books.shape == (16, 3, 1) and found.agg({"error": "sum"}).first()[0] == 0


def test_codes_of_nothing_and_of_uneven_vectors(spark):
    assert code_vectors.compress(frame(spark, []))[0].count() == 0
    assert code_vectors.compress(frame(spark, [(1, None, 1), (None, [1.0], 1)]))[0].count() == 0
    rows = [(i, [float(i % 7)] * (1 + i % 5), i % 2) for i in range(40)]
    found, books = code_vectors.compress(frame(spark, rows), parts=2, entries=4)
    want, digest = brute_codes(rows, 2, 4, 2)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want and code_vectors.books_digest(books) == digest


def test_matrix_has_the_sums_and_the_law():
    blocks, shards = [5, 0, 17, 3, 40, 1], sharding.shard_sizes(66, 4)
    total = np.zeros((6, 4))
    for seed in range(400):
        m = np.array(sharding.communication_matrix(blocks, shards, seed))
        assert m.sum(1).tolist() == blocks and m.sum(0).tolist() == shards and (m >= 0).all()
        total += m
    want = np.outer(blocks, shards) / 66
    assert np.abs(total / 400 - want).max() < 0.5
    assert sharding.communication_matrix([], [0, 0], 1) == []


def test_large_draws_have_the_mean_and_variance():
    rng = np.random.default_rng(1)
    for good, bad, drawn in ((3 * 10 ** 9, 10 ** 9, 10 ** 6), (10 ** 9, 4 * 10 ** 9, 3 * 10 ** 9), (2 * 10 ** 9, 30, 10 ** 9)):
        n = good + bad
        x = np.array([sharding.hypergeometric(rng, good, bad, drawn) for _ in range(600)], float)
        mean, var = drawn * good / n, drawn * good / n * bad / n * (n - drawn) / (n - 1)
        assert abs(x.mean() - mean) < 5 * math.sqrt(var / 600) and 0.75 < x.var() / var < 1.3
        assert x.min() >= max(0, drawn - bad) and x.max() <= min(good, drawn)
    # the same law as the library's on sizes that both know
    rng = np.random.default_rng(2)
    ours = np.array([sharding.hypergeometric(rng, 70, 30, 45) for _ in range(3000)])
    assert abs(ours.mean() - 31.5) < 0.3


DOCS = "doc_id long, text string, lang string, size long, shard int, slot string, _row string, _id string"


def documents(spark, n=600, slices=7):
    rows = [(i, None if i % 50 == 0 else "" if i % 51 == 0 else "copy" if i % 3 == 0 else f"é text {i}" * (1 + i % 4)) for i in range(n)]
    rows += [(7, "again"), (7, "again"), (None, "no id"), (None, None)] + [(n, "same row")] * 200
    return rows, spark.createDataFrame([(i, t, "en", -1, -1, "s", "r", "i") for i, t in rows], DOCS).repartition(slices)


def test_shards_hold_every_row_once_in_gapless_slots(spark):
    rows, docs = documents(spark)
    for slot_rows in (8192, 10):
        out = sharding.dealt(sharding.measured(docs), 16, slot_rows=slot_rows).collect()
        assert collections.Counter((r["doc_id"], r["text"]) for r in out) == collections.Counter(rows)
        by = collections.defaultdict(list)
        for r in out:
            raw = (r["text"] or "").encode()
            assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["_row"] == "r"
            by[r["shard"]].append(r["slot"])
        sizes = [len(by[k]) for k in range(16)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
        copies = collections.Counter(r["shard"] for r in out if r["text"] == "same row")  # 200 equal rows go everywhere
        assert len(copies) == 16 and max(copies.values()) < 35


def test_shuffle_is_uniform(spark):
    """Tenths of the input against shards and tenths of slots, for two seeds; another seed is another shuffle."""
    n, seen = 20_000, []
    for seed, slot_rows in ((1, 8192), (100, 40)):
        rows = sharding.dealt(spark.range(0, n, 1, 5).selectExpr("id as doc_id"), 4, seed=seed, slot_rows=slot_rows).collect()
        table = np.zeros((10, 4, 10))
        for r in rows:
            table[r["doc_id"] * 10 // n, r["shard"], r["slot"] * 10 // 5000] += 1
        assert (table.sum((0, 2)) == 5000).all()
        assert 270 < ((table - 50) ** 2 / 50).sum() < 450  # about 10 x 40 cells less the margins: 351 degrees of freedom
        seen.append({r["doc_id"]: (r["shard"], r["slot"]) for r in rows})
    assert sum(seen[0][i] == seen[1][i] for i in range(n)) < 20


def test_shards_of_nothing_and_of_few_rows(spark):
    assert sharding.dealt(sharding.measured(documents(spark)[1].limit(0))).count() == 0
    out = sharding.dealt(spark.range(3).selectExpr("id as doc_id"), 16).collect()
    assert sorted(r["shard"] for r in out) == [0, 1, 2] and {r["slot"] for r in out} == {0}


def test_written_shards_hold_whole_documents(spark, tmp_path):
    rows, docs = documents(spark, n=90)
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert collections.Counter((r["doc_id"], r["text"]) for r in back.collect()) == collections.Counter(rows)
    assert {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_sharding_runs_no_python(spark):
    plan = sharding.dealt(sharding.measured(documents(spark)[1]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
