"""Every stage of the corpus pipeline, run as a chain, against a plain version of it."""
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from strata.llm import common, toxicity

IP = re.compile(r"\d+\.\d+\.\d+\.\d+")


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i: i + 5]) for i in range(len(w) - 4)}


def ip_pseudonym(m):
    """Eight Feistel rounds over the two halves of an address."""
    a, b, c, d = map(int, m[0].split("."))
    l, r = a * 256 + b, c * 256 + d
    noise = lambda i, x: int(hashlib.sha256(f"example key|ip|{i}|{x}".encode()).hexdigest()[:15], 16)
    for i in range(8):
        if i % 2 == 0:
            l = (l + noise(i, r)) % 65536
        else:
            r = (r + noise(i, l)) % 65536
    return f"{l // 256}.{l % 256}.{r // 256}.{r % 256}"


def fixture():
    """(doc_id, text, lang, source), labels and items: toxic documents, near copies, leaks and addresses, also overlapping."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijklmnoprstu") for _ in range(7))
    vocabulary = [word() for _ in range(4000)]
    items = [" ".join(rnd.choice(vocabulary) for _ in range(30)) for _ in range(4)]
    docs, labels = [], []
    for i in range(400):
        w = [rnd.choice(vocabulary) for _ in range(60)]
        if i % 5 == 2:
            w.insert(10, "slurword")
        if i % 11 == 4:
            w.insert(20, "10.%d.3.7" % (i % 250))
        if i % 17 == 3:
            w += items[i % 4].upper().split()
        if i % 7 == 6:  # a copy of the document before, but for its last word
            w = docs[-1][1].split(" ")[:-1] + ["other"]
        docs.append((i, " ".join(w), ("en", "de", "fr")[rnd.randrange(3)], "s%d" % (rnd.random() < 0.3)))
        labels.append((i, int("slurword" in w)))
    return docs, labels, items


def harmless(docs, model):
    """Documents that the model scores under one half: bias, weights and every pair of factors, term by term."""
    out = []
    for d in docs:
        _, _, t = next(iter(common.slices(pa.RecordBatch.from_arrays([pa.array([d[1]])], names=["text"]), lower=True)))
        at = [i for i, h in enumerate(model.terms.tolist()) if h in set(toxicity.term_hashes(t)[0].tolist())]
        z = model.bias + sum(model.linear[i] for i in at) + sum(model.pairs[i] @ model.pairs[j] for i in at for j in at if i < j)
        if 1 / (1 + np.exp(-z)) < 0.5:
            out.append(d)
    return out


def one_of_each(docs):
    sets = [shingles(t) for _, t, _, _ in docs]
    group = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if x == old else x for x in group]
    least = {}
    for d, g in zip(docs, group):
        least[g] = min(least.get(g, d[0]), d[0])
    return [d for d, g in zip(docs, group) if least[g] == d[0]]


def probabilities(docs):
    """Of each (lang, source): raked by plain loops; all texts are of one topic."""
    cells = collections.Counter()
    for _, t, lang, source in docs:
        cells[source, lang] += len(t.split())
    weight = dict.fromkeys(cells, 1.0)
    goals = []
    for k, power in ((0, 0.5), (1, 0.7)):
        own = collections.Counter()
        for c, n in cells.items():
            own[c[k]] += n
        goals.append({v: n ** power / sum(x ** power for x in own.values()) for v, n in own.items()})
    for _ in range(200):
        for k in (0, 1):
            now = collections.Counter()
            for c, n in cells.items():
                now[c[k]] += n * weight[c]
            weight = {c: w * goals[k][c[k]] / now[c[k]] for c, w in weight.items()}
    return {c: w / max(weight.values()) for c, w in weight.items()}


def test_stages_are_brute_force(spark, tmp_path, monkeypatch):
    docs, labels, items = fixture()
    spark.createDataFrame([(*d, len(d[1])) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages, write = {}, corpus_pipeline.common.scratch_table

    def kept(df, name, *rest):
        out = write(df, name, *rest)
        if name.startswith("pipeline-"):
            stages[name.removeprefix("pipeline-")] = out
        return out

    monkeypatch.setattr(corpus_pipeline.common, "scratch_table", kept)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert list(stages) == [name for name, _ in corpus_pipeline.STAGES]
    rows = lambda df: sorted((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect())

    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")
    want = harmless(docs, toxicity.train(read("documents"), read("labels")))
    toxic = [d for d in docs if "slurword" in d[1].split()]
    assert any(zlib.crc32(str(d[0]).encode()) % 5 == 0 for d in toxic)  # some of them without a label that counts
    assert not [d for d in want if d in toxic] and len(docs) - len(toxic) - len(want) < 20
    assert rows(stages["toxicity"]) == want
    before, want = want, one_of_each(want)
    assert len(want) < len(before) and rows(stages["ngram_join"]) == want
    before, want = want, [d for d in want if not any(100 * len(shingles(x) & shingles(d[1])) >= 80 * len(shingles(x)) for x in items)]
    assert len(want) < len(before) and rows(stages["decontaminate"]) == want
    before, want = want, [(i, IP.sub(ip_pseudonym, t), *rest) for i, t, *rest in want]
    assert before != want and rows(stages["pii"]) == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages["pii"].collect())

    share = probabilities(want)
    draw = {r["i"]: r["h"] % (1 << 40) / (1 << 40) for r in spark.createDataFrame([d[:2] for d in want], "i long, t string").select(
        "i", F.xxhash64(F.col("i").cast("string"), "t").alias("h")).collect()}
    assert all(abs(draw[d[0]] - share[d[3], d[2]]) > 1e-4 for d in want)  # no document on the edge
    sampled = [d for d in want if draw[d[0]] < share[d[3], d[2]]]
    assert 0 < len(sampled) < len(want) and rows(out) == sampled
    assert np.allclose([r["probability"] for r in out.collect()], [share[r["source"], r["lang"]] for r in out.collect()], atol=1e-4)


def _write(spark, base, rows, schema, labels, items):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, weight double, probability double, topic string, score double, family long, keys string, _source string, n_tokens long, size int"


def test_pipeline_of_odd_rows_and_clashing_names(spark, tmp_path):
    """Null ids, texts, languages and sources, repeated rows and columns named like the operators' own."""
    docs, labels, items = fixture()
    rows = [(i, t, lang, src, len(t), 7.0, 8.0, "t", 9.0, 1, "k", "_s", -1, 5) for i, t, lang, src in docs]
    rows += [rows[3], rows[3], (None, "a text without an id " * 9, "en", None, 0, 7.0, 8.0, None, 9.0, 1, "k", "_s", -1, 5),
             (9001, None, None, None, None, None, None, None, None, None, None, None, None, None), (9002, "", "en", "s0", 0, 7.0, 8.0, "t", 9.0, 1, "k", "_s", -1, 5)]
    base = str(tmp_path / "odd")
    _write(spark, base, rows, CLASHING, [(i, 1, t) for i, t in labels], list(enumerate(items)))
    out = corpus_pipeline.run(spark, base)
    assert sorted(out.columns) == sorted(c.split()[0] for c in CLASHING.split(", "))
    got = out.collect()
    assert len(got) > 5 and all(0 < r["probability"] <= 1 and r["weight"] > 0 for r in got) and {r["_source"] for r in got} <= {"_s", None}
    assert {r["size"] for r in got} <= {5, None} and sum(r["doc_id"] == rows[3][0] for r in got) <= 1


def test_pipeline_of_nothing(spark, tmp_path):
    base = str(tmp_path / "empty")
    _write(spark, base, [], CLASHING, [], [])
    assert corpus_pipeline.run(spark, base).count() == 0
