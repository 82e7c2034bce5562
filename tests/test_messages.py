"""Message passing by joins against the dense tape of one patch."""

from __future__ import annotations

import numpy as np
import pytest
from test_tall import dense, random_graph

from spindle.operators import embedding as em
from spindle.operators import messages as mg
from spindle.operators import tall


def tape_loss(kind, w, x, pairs, params, dim, n, noise):
    """Loss and gradients of the same model on the tape."""
    ps = [em.Var(p) for p in params]
    i, j, y = pairs
    if kind == "graphsage":
        mean = w / np.maximum(w.sum(axis=1, keepdims=True), 1)
        f, h_ = x.shape[1], params[0].shape[1]
        w1 = [ps[0].rows(np.arange(f)), ps[0].rows(np.arange(f, 2 * f))]
        w2 = [ps[1].rows(np.arange(h_)), ps[1].rows(np.arange(h_, 2 * h_))]
        h = (em.Var(x) @ w1[0] + em.Var(mean @ x) @ w1[1]).relu()
        z, kl = h @ w2[0] + h.under(mean) @ w2[1], None
    else:
        s = em.gcn_norm(w)
        h = (em.Var(s @ x) @ ps[0]).relu().under(s)
        z, kl = h @ ps[1], None
        if kind == "vgae":
            mu, logs = z, h @ ps[2]
            z = mu + logs.exp() * noise
            kl = (mu * mu + (logs * 2.0).exp() + logs * -2.0).total() * (0.5 / n / n)
    loss = (z.rows(i) * z.rows(j)).row_sums().bce(y[:, None])
    loss = loss if kl is None else loss + kl
    loss.backward()
    return float(loss.value), [p.grad for p in ps]


@pytest.mark.parametrize("kind", ["gae", "vgae", "graphsage"])
def test_training_equals_the_tape(spark, kind):
    n, dim, hidden = 12, 2, 3
    graph, w = random_graph(spark, n, 0.4, 11)
    x = tall.normal(graph.ids, 4, 1)
    dx = dense(x, n)
    pairs = mg.link_pairs(graph, seed=5)
    rows = pairs.collect()
    edges = {(int(i) * 3 + 5, int(j) * 3 + 5) for i, j in zip(*np.nonzero(np.triu(w)))}
    assert {(r.i, r.j) for r in rows if r.y == 1} == edges and not {(r.i, r.j) for r in rows if r.y == 0} & edges and any(r.y == 0 for r in rows)
    got = mg.train(graph, x.withColumnRenamed("v", "x"), dim, kind, hidden, epochs=2, rate=0.05, pairs=pairs, seed=3)
    rng = np.random.default_rng(3)
    glorot = lambda r, c: rng.uniform(-1, 1, (r, c)) * np.sqrt(6 / (r + c))
    k = 2 if kind == "graphsage" else 1
    params = [glorot(k * 4, hidden), glorot(k * hidden, dim)] + ([glorot(k * hidden, dim)] if kind == "vgae" else [])
    at = np.array([((r.i - 5) // 3, (r.j - 5) // 3) for r in rows]).T
    y = np.array([r.y for r in rows])
    moments, history = [(0, 0)] * len(params), []
    for epoch in (1, 2):
        noise = dense(tall.normal(graph.ids, dim, 3 * 1_000_003 + epoch), n)
        loss, grads = tape_loss(kind, w, dx, (at[0], at[1], y), params, dim, n, noise)
        history.append(loss)
        if epoch == 1:
            moments = [(0.1 * g, 0.001 * g**2) for g in grads]
            params = [p - 0.05 * (a / 0.1) / (np.sqrt(b / 0.001) + 1e-8) for p, (a, b) in zip(params, moments)]
    assert np.allclose(got.history, history, atol=1e-9)
    if history[1] < history[0]:
        assert all(np.allclose(a, b, atol=1e-8) for a, b in zip(got.weights, params))
    z = {r.node_id: r.coord for r in mg.encode(got, graph, x.withColumnRenamed("v", "x")).collect()}
    assert len(z) == n and all(len(v) == dim for v in z.values())
