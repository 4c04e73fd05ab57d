"""Labels reach all repeats of a carrier, as exact inference on the run of them gives."""

import numpy as np
import pytest

from foliant.llm import pii


@pytest.mark.parametrize("at", [0, 299, 120])
def test_every_repeat_is_reached(at):
    c, n = 1e5, 300
    flat = {"prior": np.log(np.full(5, 0.2)), "features": {}, "c": np.ones((5, 5)), "s": np.ones((5, 5)) + c * np.eye(5)}
    text = " then ".join(["12345678x"] * n)
    nodes = pii.carriers(text)
    chain, skip = pii.edges_of(text, nodes)
    p = pii.marginals(nodes, [3 if i == at else 0 for i in range(n)], chain, skip, flat)
    exact = 0.2 + 0.8 * (c / (5 + c)) ** np.abs(np.arange(n) - at)
    assert p[:, 3] == pytest.approx(exact, abs=1e-6) and (p[:, 3] > 0.5).all()


def test_loops_settle_as_brute_force():
    """A loop of chain and skip edges: the sweeps' verdicts are those of the sum over all labellings."""
    import itertools

    flat = {"prior": np.log(np.full(5, 0.2)), "features": {}, "c": np.ones((5, 5)) + 2 * np.eye(5), "s": np.ones((5, 5)) + 20 * np.eye(5)}
    text = "12345678x 77777 12345678x 12345678y"
    nodes = pii.carriers(text)
    chain, skip = pii.edges_of(text, nodes)
    labels = [3, 0, 0, 0]
    p, exact = pii.marginals(nodes, labels, chain, skip, flat), np.zeros((4, 5))
    for y in itertools.product(range(5), repeat=4):
        if y[0] == 3:
            weight = np.prod([flat["c"][y[a], y[b]] for a, b in chain] + [flat["s"][y[a], y[b]] for a, b in skip])
            exact[range(4), y] += weight
    exact /= exact.sum(axis=1, keepdims=True)
    assert (p.argmax(axis=1) == exact.argmax(axis=1)).all() and np.abs(p - exact).max() < 0.1
