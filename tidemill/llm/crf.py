"""A linear-chain conditional random field with two labels, over many chains at once.

Of two labels only differences count: a position has one score (label 1 over label 0), a step has
four transition scores, and the first position of a chain one more.  Chains are cut into blocks.
The product of a block's 2 x 2 matrices says how it carries a message through, so messages pass
from block to block first and then through all blocks side by side: exact forward-backward sums,
with as many array steps as a block has positions, however long a chain is.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Positions of a block.
BLOCK = 48
#: Bound of a position's score.
MOST = 30.0


@dataclass
class Chain:
    """Transition scores [from][to] and the first position's score for label 1."""

    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    first: float = 0.0


def _scaled(*parts: np.ndarray) -> None:
    total = parts[0].copy()
    for p in parts[1:]:
        total += p
    for p in parts:
        p /= total


def marginals(scores: np.ndarray, bounds: np.ndarray, chain: Chain, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The probability of label 1 at each position of the chains that ``bounds`` cuts, and, if asked for,
    the expected number of each transition (2 x 2)."""
    n = len(scores)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    w = np.exp(np.clip(scores, -MOST, MOST)).astype(np.float64)
    a = np.exp(chain.steps)
    lengths = np.diff(bounds)
    full = np.flatnonzero(lengths)
    blocks = (lengths[full] + BLOCK - 1) // BLOCK
    head = np.concatenate([[0], np.cumsum(blocks)])  # the first block of each chain
    nth = np.arange(head[-1]) - np.repeat(head[:-1], blocks)
    begin = np.repeat(bounds[:-1][full], blocks) + nth * BLOCK
    size = np.minimum(np.repeat(bounds[1:][full], blocks) - begin, BLOCK)
    order = np.argsort(-size, kind="stable")
    b, s, opening = begin[order], size[order], nth[order] == 0
    active = np.searchsorted(-s, -np.arange(BLOCK), "left")  # blocks longer than j

    # What each block does to a message.  A chain's first position has no step before it.
    p = [np.ones(len(b)), np.zeros(len(b)), np.zeros(len(b)), np.ones(len(b))]
    for j in range(BLOCK):
        k = active[j]
        if not k:
            break
        x = w[b[:k] + j]
        p00, p01, p10, p11 = (v[:k] for v in p)
        if j == 0:
            o = opening[:k]
            m00, m01, m10, m11 = np.where(o, 1.0, a[0, 0]), np.where(o, 0.0, a[0, 1]) * x, np.where(o, 0.0, a[1, 0]), np.where(o, 1.0, a[1, 1]) * x
            p00[:], p01[:], p10[:], p11[:] = m00, m01, m10, m11
        else:
            q00, q01 = p00 * a[0, 0] + p01 * a[1, 0], (p00 * a[0, 1] + p01 * a[1, 1]) * x
            q10, q11 = p10 * a[0, 0] + p11 * a[1, 0], (p10 * a[0, 1] + p11 * a[1, 1]) * x
            p00[:], p01[:], p10[:], p11[:] = q00, q01, q10, q11
        if j % 4 == 3:
            _scaled(p00, p01, p10, p11)
    _scaled(*p)
    back = np.empty(len(b), np.int64)
    back[order] = np.arange(len(b))
    p = [v[back] for v in p]

    # Messages into the blocks from the left and from the right.
    left0, left1 = np.empty(len(b)), np.empty(len(b))
    right0, right1 = np.ones(len(b)), np.ones(len(b))
    left0[head[:-1]], left1[head[:-1]] = 1.0, np.exp(chain.first)
    by_blocks = np.argsort(-blocks, kind="stable")
    starts, many = head[:-1][by_blocks], blocks[by_blocks]
    for j in range(1, int(blocks.max())):
        at = starts[: np.searchsorted(-many, -j, "left")] + j  # block j of the chains that have one
        u0, u1 = left0[at - 1], left1[at - 1]
        v0, v1 = u0 * p[0][at - 1] + u1 * p[2][at - 1], u0 * p[1][at - 1] + u1 * p[3][at - 1]
        left0[at], left1[at] = v0 / (v0 + v1), v1 / (v0 + v1)
    for j in range(int(blocks.max()) - 1, 0, -1):
        at = starts[: np.searchsorted(-many, -j, "left")] + j
        u0, u1 = right0[at], right1[at]
        v0, v1 = p[0][at] * u0 + p[1][at] * u1, p[2][at] * u0 + p[3][at] * u1
        right0[at - 1], right1[at - 1] = v0 / (v0 + v1), v1 / (v0 + v1)

    # Through all blocks side by side.
    f0, f1 = np.empty(n), np.empty(n)
    u0, u1 = left0[order], left1[order]
    for j in range(BLOCK):
        k = active[j]
        if not k:
            break
        at = b[:k] + j
        x = w[at]
        if j == 0:
            o = opening[:k]
            v0 = np.where(o, u0[:k], u0[:k] * a[0, 0] + u1[:k] * a[1, 0])
            v1 = np.where(o, u1[:k], u0[:k] * a[0, 1] + u1[:k] * a[1, 1]) * x
        else:
            v0, v1 = u0[:k] * a[0, 0] + u1[:k] * a[1, 0], (u0[:k] * a[0, 1] + u1[:k] * a[1, 1]) * x
        total = v0 + v1
        u0[:k], u1[:k] = v0 / total, v1 / total
        f0[at], f1[at] = u0[:k], u1[:k]
    found = np.empty(n)
    u0, u1 = right0[order], right1[order]
    expected = np.zeros((2, 2))
    for j in range(BLOCK - 1, -1, -1):
        k = active[j]
        if not k:
            continue
        at = b[:k] + j
        on, off = f1[at] * u1[:k], f0[at] * u0[:k]
        found[at] = on / (on + off)
        x = w[at]
        if pairs:
            inner = np.ones(k, bool) if j else ~opening[:k]
            before = at[inner] - 1
            g0, g1 = u0[:k][inner], u1[:k][inner] * x[inner]
            t = [f0[before] * a[0, 0] * g0, f0[before] * a[0, 1] * g1, f1[before] * a[1, 0] * g0, f1[before] * a[1, 1] * g1]
            total = t[0] + t[1] + t[2] + t[3]
            expected += np.array([[(t[0] / total).sum(), (t[1] / total).sum()], [(t[2] / total).sum(), (t[3] / total).sum()]])
        v0, v1 = a[0, 0] * u0[:k] + a[0, 1] * x * u1[:k], a[1, 0] * u0[:k] + a[1, 1] * x * u1[:k]
        total = v0 + v1
        u0[:k], u1[:k] = v0 / total, v1 / total
    return found, expected


def fit(gather, spread, n_weights: int, labels: np.ndarray, bounds: np.ndarray, rounds: int = 60, rate: float = 0.3, decay: float = 1e-4, weigh: np.ndarray | None = None, bias: float = 0.0) -> tuple[np.ndarray, Chain]:
    """Weights and transitions that make ``labels`` (0 or 1 at each position) likely, by AdaGrad steps along
    the conditional likelihood's gradient: observed less expected features.

    ``gather(weights)`` gives the positions' scores, ``spread(errors)`` the gradient of the weights;
    ``weigh`` is how much each position counts, ``bias`` where the first weight starts."""
    weights, chain = np.zeros(n_weights), Chain()
    weights[0] = bias
    grown, grown_steps, grown_first = np.full(n_weights, 1e-8), np.full((2, 2), 1e-8), 1e-8
    weigh = np.ones(len(labels)) if weigh is None else weigh
    inner = np.ones(len(labels), bool)
    heads = bounds[:-1][np.diff(bounds) > 0]
    inner[heads] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[at - 1], labels[at]), 1.0)
    for _ in range(rounds):
        m, expected = marginals(gather(weights), bounds, chain, pairs=True)
        slope = spread((labels - m) * weigh) / len(labels) - decay * weights
        grown += slope**2
        weights += rate * slope / np.sqrt(grown)
        slope_steps = (seen - expected) / len(labels) - decay * chain.steps
        grown_steps += slope_steps**2
        chain.steps = chain.steps + rate * slope_steps / np.sqrt(grown_steps)
        slope_first = float((labels[heads] - m[heads]).sum()) / len(labels) - decay * chain.first
        grown_first += slope_first**2
        chain.first += rate * slope_first / grown_first**0.5
    return weights, chain


def logistic(x: np.ndarray, y: np.ndarray, weigh: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights of the columns of x, the last of which should be 1, by Newton's method."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -MOST, MOST)))
        slope = x.T @ (weigh * (y - p)) - ridge * beta
        curve = (x * (weigh * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta
