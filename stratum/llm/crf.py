"""Linear-chain conditional random fields: forward-backward, Viterbi decoding and training, vectorised over many chains."""

from __future__ import annotations

import numpy as np

from stratum.llm.common import ragged


def forward_backward(emit: np.ndarray, starts: np.ndarray, lengths: np.ndarray, trans: np.ndarray):
    """Marginals of every token of many chains at once.

    emit: scores [tokens, labels]; a chain is a range of tokens. All chains advance together, one position a step, those
    that have ended dropping out. Returns marginals, expected transition counts and the sum of log partition functions.
    """
    order = np.argsort(-lengths, kind="stable")
    first, size = starts[order], lengths[order]
    peak = emit.max(1, keepdims=True)
    e = np.maximum(np.exp(emit - peak), 1e-30)
    step = np.exp(trans)
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty(len(e), e.dtype)
    longest = int(size[0]) if len(size) else 0
    live = len(size) - np.cumsum(np.bincount(size, minlength=longest + 1))  # chains longer than t
    a = None
    for t in range(longest):
        at = first[: live[t]] + t
        a = e[at] if t == 0 else (a[: live[t]] @ step) * e[at]
        s = a.sum(1)
        a = a / s[:, None]
        alpha[at], scale[at] = a, s
    for t in range(longest - 2, -1, -1):
        at = first[: live[t + 1]] + t
        beta[at] = ((e[at + 1] * beta[at + 1]) @ step.T) / scale[at + 1, None]
    marginal = alpha * beta
    marginal /= marginal.sum(1, keepdims=True)
    inner = np.ones(len(e), bool)
    inner[starts] = False
    later = np.flatnonzero(inner)
    pairs = step * (alpha[later - 1].T @ (e[later] * beta[later] / scale[later, None]))
    return marginal, pairs, float(np.log(scale).sum() + peak.sum())


def viterbi(emit: np.ndarray, trans: np.ndarray, border: int) -> list[int]:
    """The best labels of one chain that stands between two tokens labelled `border`."""
    best, back = trans[border] + emit[0], []
    for row in emit[1:]:
        through = best[:, None] + trans
        back.append(through.argmax(0))
        best = through.max(0) + row
    path = [int((best + trans[:, border]).argmax())]
    for pointers in reversed(back):
        path.append(int(pointers[path[-1]]))
    return path[::-1]


def fit(
    features: np.ndarray, bounds: np.ndarray, gold: np.ndarray, lengths: np.ndarray, n_features: int, n_labels: int,
    *, border: int | None = None, forbidden: np.ndarray | None = None, epochs: int = 6, batch: int = 256, rate: float = 0.3,
    l2: float = 1e-5, seed: int = 7,
) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights [features, labels] and transitions [labels, labels] by adaptive gradient ascent on the likelihood.

    features holds the feature numbers of all tokens in a row, bounds where each token's begin (and the end); every token
    has one at least. border: the label that surrounds every chain, or None. forbidden: transitions that stay impossible.
    """
    rng = np.random.default_rng(seed)
    weights, trans = np.zeros((n_features, n_labels)), np.zeros((n_labels, n_labels))
    blocked = np.zeros((n_labels, n_labels), bool) if forbidden is None else forbidden
    trans[blocked] = -30.0
    seen_w, seen_t = np.full_like(weights, 1e-8), np.full_like(trans, 1e-8)
    begins = np.cumsum(lengths) - lengths
    for _ in range(epochs):
        for chunk in np.array_split(rng.permutation(len(lengths)), max(1, len(lengths) // batch)):
            size = lengths[chunk]
            tokens = ragged(begins[chunk], size)
            per = bounds[tokens + 1] - bounds[tokens]
            ids = features[ragged(bounds[tokens], per)]
            emit = np.add.reduceat(weights[ids], np.cumsum(per) - per)
            starts = np.cumsum(size) - size
            ends = starts + size - 1
            if border is not None:
                np.add.at(emit, starts, trans[border])
                np.add.at(emit, ends, trans[:, border])
            marginal, pairs, _ = forward_backward(emit, starts, size, trans)
            truth = gold[tokens]
            miss = -marginal
            miss[np.arange(len(tokens)), truth] += 1
            inner = np.ones(len(tokens), bool)
            inner[starts] = False
            later = np.flatnonzero(inner)
            step = -pairs
            np.add.at(step, (truth[later - 1], truth[later]), 1)
            if border is not None:
                step[border] += miss[starts].sum(0)
                step[:, border] += miss[ends].sum(0)
            step[blocked] = 0
            owner = np.repeat(np.arange(len(tokens)), per)
            slope = np.stack([np.bincount(ids, miss[owner, k], n_features) for k in range(n_labels)], 1) / len(chunk) - l2 * weights
            step /= len(chunk)
            seen_w += slope**2
            seen_t += step**2
            weights += rate * slope / np.sqrt(seen_w)
            trans += rate * step / np.sqrt(seen_t)
    trans[blocked] = -1e9
    return weights, trans
