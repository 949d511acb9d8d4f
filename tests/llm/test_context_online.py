import math

import numpy as np
import pytest

from cellweave.llm import context_mixing as cm
from cellweave.llm import context_online


@pytest.fixture(scope="module")
def parts(spark):
    texts = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "Überall 12"] * 5
    return cm.count_contexts(spark.createDataFrame([(t,) for t in texts], "text string"))


def model(parts):
    return cm.Model(parts, cm.first_weights(), cm.flat_map())


def bit_by_bit(m, text, rate, map_rate):
    """One bit after the other in plain floats: predict, then move the gate's weights and the two cells of the map that it lies between."""
    weights, cells, total = m.weights.astype(float).copy(), m.refined.astype(float).copy(), 0.0
    flat, own = cm.laid_out([cm.coded(text)])
    runs = cm.Runs(flat, own, inverse=True)
    for byte in range(len(runs.number)):
        for rows, ones, nodes in runs.pieces(runs.number[byte : byte + 1]):
            inputs, gates = m.inputs(runs, rows, ones, nodes, less=False)
            w0, c0 = weights.copy(), cells.copy()  # a piece is a byte: its bits are predicted together
            for k, one in enumerate(ones.ravel().tolist()):
                g, x = int(gates[k]), inputs[:, k].astype(float)
                odds = min(18, max(-18, sum(a * b for a, b in zip(w0[g], x))))
                p = 1 / (1 + math.exp(-odds))
                at = min(cm.LEVELS - 1.001, max(0, (odds + cm.REACH) * (cm.LEVELS - 1) / (2 * cm.REACH)))
                low, part = int(at), at - int(at)
                mapped = c0[g, low] * (1 - part) + c0[g, low + 1] * part
                final = min(1 - 1e-6, max(1e-6, (p + 3 * mapped) / 4 if abs(odds) < cm.REACH else p))
                total += math.log(final if one else 1 - final)
                weights[g] += rate * (one - p) * x
                cells[g, low] += map_rate * (1 - part) * (one - c0[g, low])
                cells[g, low + 1] += map_rate * part * (one - c0[g, low + 1])
    return total, weights, cells


@pytest.mark.parametrize("text", [None, "", "the cat sat on the Über log, 77", "the dog " * 30])
def test_update_equals_bit_by_bit(parts, text):
    m = model(parts)
    want, weights, cells = bit_by_bit(m, text, 0.02, 0.005)
    online = context_online.Online(m, 1, 0.02, 0.005)
    assert online.text(text) == pytest.approx(want, rel=1e-4)
    assert np.allclose(m.weights, weights, atol=1e-3) and np.allclose(m.refined, cells, atol=1e-4)


def test_learning_makes_texts_cheaper(parts):
    m = model(parts)
    texts = ["the cat sat on the mat and the dog sat on the log"] * 40
    first = context_online.Online(model(parts)).text(texts[0])
    context_online.learned(m, texts, rate=0.02)
    assert context_online.Online(m).text(texts[0]) > first
