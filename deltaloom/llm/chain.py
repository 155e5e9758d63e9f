"""Linear chains over many sequences at once: Viterbi, forward-backward, and conditional random fields.

Sequences are cut into chunks that advance in lockstep, one numpy step for all chunks. What a
chunk does to any state that enters it is a small matrix; the matrices are chained over a
sequence's chunks first, then every chunk runs with its true entering state. Results are
those of one pass over the uncut sequence, and a very long sequence takes no more steps.
"""

from __future__ import annotations

import numpy as np

CHUNK = 128
LOW = -1e30


class Lanes:
    """Chunks of sequences, the longest first; ``rows[t]`` are the token rows that step t handles."""

    def __init__(self, lengths: np.ndarray, chunk: int = CHUNK):
        lengths = np.asarray(lengths, np.int64)
        n = -(-lengths // chunk)
        seq = np.repeat(np.arange(lengths.size), n)
        pos = np.arange(seq.size) - np.repeat(np.cumsum(n) - n, n)
        first = np.repeat(np.cumsum(lengths) - lengths, n) + pos * chunk
        size = np.minimum(chunk, lengths[seq] - pos * chunk)
        order = np.argsort(-size, kind="stable")
        self.n, self.pos, self.first, self.size = seq.size, pos[order], first[order], size[order]
        self.steps = int(size.max(initial=0))
        self.active = [int(np.searchsorted(-self.size, -t, side="left")) for t in range(self.steps)]
        where = np.empty(seq.size, np.int64)
        where[order] = np.arange(seq.size)
        self.next = np.full(seq.size, -1)  # lane of the following chunk
        same = np.flatnonzero(seq[1:] == seq[:-1])
        self.next[where[same]] = where[same + 1]
        by = np.argsort(self.pos, kind="stable")
        self.turns = np.split(by, np.flatnonzero(np.diff(self.pos[by])) + 1) if seq.size else []

    def rows(self, t: int) -> np.ndarray:
        return self.first[: self.active[t]] + t


def _with_start(trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.vstack([trans, start])


def viterbi(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray | None = None, chunk: int = CHUNK) -> np.ndarray:
    """The best label of each row of ``scores`` (tokens x labels); ``trans[i, j]`` scores label j after i. Ties go to the lower label."""
    n, k = scores.shape
    if not n:
        return np.zeros(0, np.int64)
    lanes, full = Lanes(lengths, chunk), _with_start(trans, np.zeros(k) if start is None else start)
    through = np.empty((lanes.n, k + 1, k))
    for t in range(lanes.steps):
        a, s = lanes.active[t], scores[lanes.rows(t)][:, None, :]
        through[:a] = (full[None] if t == 0 else (through[:a, :, :, None] + trans[None, None]).max(2)) + s
    enter = np.full((lanes.n, k + 1), LOW)
    end = np.empty((lanes.n, k))
    enter[lanes.turns[0], k] = 0
    for own in lanes.turns:
        end[own] = (enter[own][:, :, None] + through[own]).max(1)
        more = own[lanes.next[own] >= 0]
        enter[lanes.next[more], :k] = end[more] - end[more].max(1, keepdims=True)
    back = np.zeros((n, k), np.uint8)
    best = np.empty((lanes.n, k))
    for t in range(lanes.steps):
        a, r = lanes.active[t], lanes.rows(t)
        step = enter[:a, :, None] + full[None] if t == 0 else best[:a, :, None] + trans[None]
        back[r] = step.argmax(1)
        best[:a] = step.max(1) + scores[r]
    paths = np.zeros((n, k), np.uint8)  # by the state at the chunk's end
    state = np.tile(np.arange(k), (lanes.n, 1))
    for t in range(lanes.steps - 1, -1, -1):
        a, r = lanes.active[t], lanes.rows(t)
        paths[r] = state[:a]
        state[:a] = back[r[:, None], state[:a]]
    last = np.zeros(lanes.n, np.int64)
    for own in reversed(lanes.turns):
        after = lanes.next[own]
        last[own] = best[own].argmax(1)
        more = own[after >= 0]
        last[more] = state[after[after >= 0], last[after[after >= 0]]]
    chosen = np.empty(n, np.int64)
    for t in range(lanes.steps):
        a, r = lanes.active[t], lanes.rows(t)
        chosen[r] = paths[r, last[:a]]
    return chosen


def marginals(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray | None = None, chunk: int = CHUNK, pairs: bool = False):
    """Posterior of each label at each row; with ``pairs`` also the expected count of each transition, and the log-likelihood's normaliser is left out."""
    n, k = scores.shape
    if not n:
        return (np.zeros((0, k)), np.zeros((k, k))) if pairs else np.zeros((0, k))
    lanes = Lanes(lengths, chunk)
    full = np.exp(_with_start(trans, np.zeros(k) if start is None else start))
    e, emit = full[:k], np.exp(scores - scores.max(1, keepdims=True))
    through = np.empty((lanes.n, k + 1, k))
    for t in range(lanes.steps):
        a, s = lanes.active[t], emit[lanes.rows(t)][:, None, :]
        through[:a] = full[None] * s if t == 0 else (through[:a] @ e) * s
        if t % 8 == 7:
            through[:a] /= through[:a].max((1, 2), keepdims=True)
    enter, after = np.zeros((lanes.n, k + 1)), np.ones((lanes.n, k))
    enter[lanes.turns[0], k] = 1
    for own in lanes.turns:
        more = own[lanes.next[own] >= 0]
        x = np.einsum("li,lij->lj", enter[more], through[more])
        enter[lanes.next[more], :k] = x / x.sum(1, keepdims=True)
    for own in reversed(lanes.turns):
        more = own[lanes.next[own] >= 0]
        following = lanes.next[more]
        x = np.einsum("lij,lj->li", through[following][:, :k], after[following])
        after[more] = x / x.sum(1, keepdims=True)
    alpha, beta = np.empty((n, k)), np.empty((n, k))
    now = np.empty((lanes.n, k))
    for t in range(lanes.steps):
        a, r = lanes.active[t], lanes.rows(t)
        now[:a] = ((enter[:a] @ full) if t == 0 else (now[:a] @ e)) * emit[r]
        now[:a] /= now[:a].sum(1, keepdims=True)
        alpha[r] = now[:a]
    for t in range(lanes.steps - 1, -1, -1):
        a, r = lanes.active[t], lanes.rows(t)
        going = lanes.active[t + 1] if t + 1 < lanes.steps else 0
        if going:
            after[:going] = (after[:going] * emit[lanes.rows(t + 1)]) @ e.T
            after[:going] /= after[:going].sum(1, keepdims=True)
        beta[r] = after[:a]
    post = alpha * beta
    post /= post.sum(1, keepdims=True)
    if not pairs:
        return post
    inner = np.ones(n, bool)
    inner[np.cumsum(lengths)[lengths > 0] - lengths[lengths > 0]] = False
    at = np.flatnonzero(inner)
    joint = alpha[at - 1][:, :, None] * e[None] * (emit[at] * beta[at])[:, None, :]
    return post, (joint / joint.sum((1, 2), keepdims=True)).sum(0)


class Crf:
    """Linear-chain conditional random field of two labels over sparse features.

    ``weights[f]`` scores label 1 against label 0 for feature f; feature 0 is the bias that every token has.
    """

    def __init__(self, weights: np.ndarray, trans: np.ndarray):
        self.weights, self.trans = weights, trans

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Scores (tokens x 2) of tokens with feature numbers ``features`` (tokens x m; 0 pads and is the bias, counted once)."""
        w = self.weights.copy()
        bias, w[0] = w[0], 0
        return np.c_[np.zeros(len(features)), w[features].sum(1) + bias]

    @classmethod
    def fit(cls, features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, n_features: int, *, rounds: int = 60, rate: float = 0.15, decay: float = 1e-5) -> Crf:
        """Maximum conditional likelihood by Adam with an L2 penalty; deterministic."""
        lengths = np.asarray(lengths, np.int64)
        crf = cls(np.zeros(n_features), np.zeros((2, 2)))
        if not len(features):
            return crf
        first = np.ones(len(labels), bool)
        first[1:] = False
        first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        at = np.flatnonzero(~first)
        seen = np.zeros((2, 2))
        np.add.at(seen, (labels[at - 1], labels[at]), 1)
        flat, m = features.ravel(), features.shape[1]
        state = [(np.zeros(n_features), np.zeros(n_features)), (np.zeros((2, 2)), np.zeros((2, 2)))]
        size = len(labels)
        for step in range(1, rounds + 1):
            post, moves = marginals(crf.scores(features), lengths, crf.trans, pairs=True)
            gap = labels - post[:, 1]
            g = np.bincount(flat, np.repeat(gap, m), n_features)
            g[0] = gap.sum()
            for (first_m, second_m), value, grad in zip(state, (crf.weights, crf.trans), (g / size, (seen - moves) / size), strict=True):
                grad = grad - decay * value
                first_m *= 0.9
                first_m += 0.1 * grad
                second_m *= 0.99
                second_m += 0.01 * grad**2
                value += rate * (first_m / (1 - 0.9**step)) / (np.sqrt(second_m / (1 - 0.99**step)) + 1e-8)
        return crf
