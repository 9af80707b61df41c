"""A linear-chain conditional random field over feature vectors, vectorised across sequences."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Chain:
    """score(labels) = start[y0] + sum of weights[y_t] . x_t + sum of moves[y_(t-1), y_t]."""

    weights: np.ndarray  # labels x features
    moves: np.ndarray  # labels x labels
    start: np.ndarray  # labels


def _order(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the non-empty sequences, longest first, and how many are longer than t, for each t."""
    size = np.diff(off)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    longest = int(size[order[0]]) if len(order) else 0
    return off[:-1][order], size[order], len(order) - np.searchsorted(np.sort(size[order]), np.arange(longest), "right")


def viterbi(chain: Chain, scores: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Best labels of all sequences; sequence i is rows ``off[i]:off[i + 1]`` of ``scores`` (rows x labels). Ties go to the smaller label."""
    n, k = scores.shape
    starts, size, active = _order(off)
    back = np.zeros((n, k), np.int8)
    out = np.zeros(n, np.int8)
    if not len(starts):
        return out
    best = scores[starts] + chain.start
    last = np.empty((len(starts), k))
    for t in range(len(active)):
        m = active[t]
        if t:
            step = best[:m, :, None] + chain.moves
            at = starts[:m] + t
            back[at] = step.argmax(axis=1)
            best = step.max(axis=1) + scores[at]
        last[:m] = best[:m]
    ends = starts + size - 1
    out[ends] = last.argmax(axis=1)
    for t in range(len(active) - 1, 0, -1):
        at = starts[: active[t]] + t
        out[at - 1] = back[at, out[at]]
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(x: np.ndarray, y: np.ndarray, off: np.ndarray, labels: int, weight: np.ndarray | None = None, rounds: int = 120, l2: float = 1e-3, rate: float = 0.15, banned: list[tuple[int, int]] = (), banned_start: list[int] = ()) -> Chain:
    """Maximum likelihood by forward-backward and Adam; deterministic. ``weight`` weighs sequences; banned moves stay impossible."""
    starts, size, active = _order(off)
    order = np.argsort(-np.diff(off), kind="stable")[: len(starts)]
    own = np.ones(len(starts)) if weight is None else weight[order]
    total = max(float((own * size).sum()), 1.0)
    feats = x.shape[1]
    shut, shut0 = np.zeros((labels, labels)), np.zeros(labels)
    for a, b in banned:
        shut[a, b] = -1e6
    for a in banned_start:
        shut0[a] = -1e6
    theta = np.zeros(labels * feats + labels * labels + labels)
    cut1, cut2 = labels * feats, labels * feats + labels * labels
    first = second = np.zeros_like(theta)
    row_weight = np.zeros(len(x))
    for s, z, w in zip(starts, size, own):
        row_weight[s : s + z] = w
    hot = np.eye(labels)[y] * row_weight[:, None]
    seen = np.zeros((labels, labels))
    for t in range(1, len(active)):
        at = starts[: active[t]] + t
        np.add.at(seen, (y[at - 1], y[at]), own[: active[t]])
    seen0 = (np.eye(labels)[y[starts]] * own[:, None]).sum(axis=0) if len(starts) else np.zeros(labels)
    for i in range(1, rounds + 1):
        w, moves, start = theta[:cut1].reshape(labels, feats), theta[cut1:cut2].reshape(labels, labels) + shut, theta[cut2:] + shut0
        scores = x @ w.T
        alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
        if len(starts):
            alpha[starts] = scores[starts] + start
        for t in range(1, len(active)):
            at = starts[: active[t]] + t
            alpha[at] = _logsum(alpha[at - 1][:, :, None] + moves, 1) + scores[at]
        expected = np.zeros((labels, labels))
        z = _logsum(alpha[starts + size - 1], 1) if len(starts) else np.zeros(0)
        for t in range(len(active) - 1, 0, -1):
            m = active[t]
            at = starts[:m] + t
            ahead = scores[at] + beta[at]
            pair = alpha[at - 1][:, :, None] + moves + ahead[:, None, :] - z[:m, None, None]
            expected += (np.exp(pair) * own[:m, None, None]).sum(axis=0)
            beta[at - 1] = _logsum(moves[None] + ahead[:, None, :], 2)
        zs = np.zeros(len(x))
        for s, n, v in zip(starts, size, z):
            zs[s : s + n] = v
        p = np.exp(alpha + beta - zs[:, None]) * row_weight[:, None]
        grad = np.concatenate([((p - hot).T @ x).ravel(), (expected - seen).ravel(), (p[starts].sum(axis=0) if len(starts) else 0) - seen0]) / total + l2 * theta
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        theta = theta - rate * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.99**i)) + 1e-8)
    return Chain(theta[:cut1].reshape(labels, feats).copy(), theta[cut1:cut2].reshape(labels, labels) + shut, theta[cut2:] + shut0)
