import numpy as np
import pytest

from daymosaic.llm import lm


def model(scale, n=900):
    rng = np.random.default_rng(1)
    units = np.concatenate([[0, 1], 1 + np.sort(rng.choice(np.arange(1, n), 40, False)), [n]])
    m = lm.Model.start(rng.integers(0, 50, n).astype(float), units)
    m.r[:], m.q[:], m.p[:] = (rng.normal(0, scale, x.shape) for x in (m.r, m.q, m.p))
    return m, rng


def log_softmax(x):
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


@pytest.mark.parametrize("scale", [0.1, 1, 8])
@pytest.mark.parametrize("room", [1, 1000, lm.ROOM])
def test_probabilities_are_normalised(scale, room, monkeypatch):
    """Small and large scores, and classes whose scores are made in parts."""
    monkeypatch.setattr(lm, "ROOM", room)
    m, rng = model(scale)
    context, target = rng.integers(0, 900, (500, lm.CONTEXT)), rng.integers(0, 900, 500)
    h = m.vectors(context).astype(float)
    wanted = log_softmax(h @ m.p.T.astype(float) + m.a)[np.arange(500), m.class_of[target]]
    inside = h @ m.q.T.astype(float) + m.b
    for i, t in enumerate(target):
        first, last = m.first[m.class_of[t]], m.first[m.class_of[t] + 1]
        wanted[i] += log_softmax(inside[i : i + 1, first:last])[0, t - first]
    assert np.allclose(m.log10_probability(context, target), wanted / lm.LOG10, rtol=1e-4, atol=1e-3)
    assert len(m.log10_probability(context[:0], target[:0])) == 0


def test_units_of_a_class_are_multiplied_once_for_many_positions(monkeypatch):
    """30,000 positions: before, a class's units were multiplied for each 8,192 of them, and score ranges read all scores."""
    m, rng = model(0.1)
    context, target = rng.integers(0, 900, (30_000, lm.CONTEXT)), rng.integers(0, 900, 30_000)
    calls, own = [], lm._own_log
    monkeypatch.setattr(lm, "_own_log", lambda *args: calls.append(1) or own(*args))
    for at in range(0, 30_000, lm.SCORED):
        m.log10_probability(context[at : at + lm.SCORED], target[at : at + lm.SCORED])
    classes = len(m.first) - 1
    assert len(calls) < 2 * classes + 30_000 * classes / lm.ROOM + 1


def test_gradients_of_equal_rows_are_added():
    m, rng = model(0.1)
    t = lm.Trainer(m, np.ones(900), 0)
    for index in (rng.integers(0, 900, 2000), rng.integers(0, 3, 500), np.arange(900), np.array([5])):
        wide, narrow = rng.normal(size=(len(index), lm.WIDTH)).astype(np.float32), rng.normal(size=len(index)).astype(np.float32)
        rows, a, b = t._by_row(index, wide, narrow)
        for got, grad in ((a, wide), (b, narrow)):
            wanted = np.zeros((900, *grad.shape[1:]))
            np.add.at(wanted, index, grad)
            assert np.array_equal(rows, np.unique(index)) and got.dtype == np.float32 and np.allclose(got, wanted[rows], atol=1e-4)
