"""Slopes of distinct bytes in context, and the cost of lanes against single decisions."""
import numpy as np
import pytest

from strata.llm import lm_score as lm


def _mixer(rng):
    code = lm.Code(rng.integers(1, 1000, 256))
    table = rng.integers(-60, 60, (int(lm._BASE[-1]), 256)).astype(np.int8)
    return lm.Mixer(code, table, rng.random((lm.GATES, len(lm.TABLES))) / 50)


def _texts(rng, sizes):
    words = [b"the", b"of", b"a", b"tree", b"trees", b"zebra9"]
    docs = []
    for n in sizes:
        text = b" ".join(words[i] for i in rng.integers(0, len(words), n)) + b"\n"
        docs.append(np.frombuffer(text, np.uint8))
    return np.concatenate(docs), np.concatenate(([0], np.cumsum([len(d) for d in docs])))


def test_distinct_bytes_are_taken_once(monkeypatch):
    rng = np.random.default_rng(6)
    mixer = _mixer(rng)
    data, offs = _texts(rng, [40, 0, 1, 300])
    rows, gate = lm.contexts(data, offs)
    keys = lm.keyed(data, rows, gate)
    back, g, symbol = lm.opened(keys)
    assert (np.stack(back, 1) == rows).all() and (g == gate).all() and (symbol == data).all()
    each = mixer.slopes(keys, np.ones(len(keys), np.int64))
    tally = lm.Tally()
    for _ in range(20):
        tally.add(keys)
    assert (tally.times.sum(), len(tally.keys)) == (20 * len(keys), len(np.unique(keys)))
    taken = lm.opened
    monkeypatch.setattr(lm, "opened", lambda k: sizes.append(len(k)) or taken(k))
    sizes: list = []
    np.testing.assert_allclose(mixer.slopes(tally.keys, tally.times), 20 * each, rtol=1e-4, atol=1e-4 * np.abs(each).max())
    assert sum(sizes) == len(np.unique(keys)) < len(keys)  # work follows the distinct ones, not the text


@pytest.mark.parametrize("sizes", [[1], [0, 3, 200, 2, 250], [400]])
def test_cost_of_lanes_is_that_of_single_decisions(sizes):
    rng = np.random.default_rng(7)
    mixer = _mixer(rng)
    data, offs = _texts(rng, sizes)
    rows, gate = lm.contexts(data, offs)
    table, code = mixer.table.reshape(-1, 256), mixer.code
    want = []
    for a, b in zip(offs[:-1], offs[1:]):
        bits = 0.0
        for i in range(a, b):
            if (i - a) % lm.LANE == 0:
                w, refine = mixer.weights.copy(), 1 / (1 + np.exp(-np.linspace(-8, 8, lm.STEPS)))
            slots, news, move = slice(code.first[data[i]], code.first[data[i] + 1]), [], 0
            for node, bit in zip(code.node[slots], code.bit[slots]):
                hint = table[rows[i], node].astype(float)
                z = np.clip(w[gate[i]] @ hint, -8, 8)
                p, cell = 1 / (1 + np.exp(-z)), int(z * (lm.STEPS - 1) / 16 + lm.STEPS / 2)
                final = (p + refine[cell]) / 2
                bits -= np.log2(max(final if bit else 1 - final, 1 / 4096))
                news.append((cell, refine[cell] + lm.REFINE * (bit - refine[cell])))
                move = move + lm.LEARN / 256 * (bit - p) * hint
            for cell, x in news:
                refine[cell] = x
            w[gate[i]] += move
        want.append(bits)
    np.testing.assert_allclose(mixer.cost(data, offs), want, rtol=2e-3)
