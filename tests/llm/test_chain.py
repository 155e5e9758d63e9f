"""Chains: Viterbi, marginals and training against enumeration of all paths."""

import itertools

import numpy as np
import pytest

from deltaloom.llm.chain import Crf, marginals, viterbi


def paths(scores, trans, start):
    n, k = scores.shape
    for p in itertools.product(range(k), repeat=n):
        yield p, start[p[0]] + sum(scores[i, p[i]] for i in range(n)) + sum(trans[a, b] for a, b in itertools.pairwise(p))


@pytest.mark.parametrize("chunk", [1, 2, 3, 128])
@pytest.mark.parametrize("seed", range(4))
def test_against_all_paths(chunk, seed):
    r = np.random.default_rng(seed)
    k, lengths = int(r.integers(2, 4)), np.array([5, 0, 1, 7, 2])
    scores, trans, start = r.normal(size=(sum(lengths), k)), r.normal(size=(k, k)), r.normal(size=k)
    best = viterbi(scores, lengths, trans, start, chunk)
    post, moves = marginals(scores, lengths, trans, start, chunk, pairs=True)
    at, seen = 0, np.zeros((k, k))
    for n in lengths:
        own = scores[at : at + n]
        if n:
            found = list(paths(own, trans, start))
            assert tuple(best[at : at + n]) == max(found, key=lambda x: x[1])[0]
            weight = np.exp([s for _, s in found])
            for (p, _), w in zip(found, weight / weight.sum(), strict=True):
                post[np.arange(at, at + n), list(p)] -= w
                for a, b in itertools.pairwise(p):
                    seen[a, b] += w
        at += n
    assert np.abs(post).max() < 1e-9 and np.abs(seen - moves).max() < 1e-9


def test_chunks_do_not_change_a_long_sequence():
    r = np.random.default_rng(1)
    scores, trans = r.normal(size=(5000, 3)), r.normal(size=(3, 3)) - 2 * (1 - np.eye(3))
    assert np.array_equal(viterbi(scores, [5000], trans, chunk=64), viterbi(scores, [5000], trans, chunk=5000))
    assert np.allclose(marginals(scores, np.array([5000]), trans, chunk=64), marginals(scores, np.array([5000]), trans, chunk=5000))


def test_ties_go_to_the_lower_label_and_nothing_is_fine():
    assert viterbi(np.zeros((4, 2)), [4], np.zeros((2, 2))).tolist() == [0, 0, 0, 0]
    assert viterbi(np.zeros((0, 2)), [0, 0], np.zeros((2, 2))).size == 0
    assert marginals(np.zeros((0, 2)), np.zeros(0, int), np.zeros((2, 2))).shape == (0, 2)


def test_field_learns_neighbours():
    r = np.random.default_rng(3)
    x, y, lengths = [], [], []
    for _ in range(60):
        labels = np.repeat(r.integers(0, 2, 6), 5)
        x += [[1 + label if r.random() < 0.7 else 2 - label] for label in labels]
        y += labels.tolist()
        lengths.append(30)
    x, y = np.array(x), np.array(y)
    crf = Crf.fit(x, y, np.array(lengths), 3)
    assert crf.trans[0, 0] + crf.trans[1, 1] > crf.trans[0, 1] + crf.trans[1, 0]
    true = Crf(np.array([0, -0.85, 0.85]), np.log([[0.9, 0.1], [0.1, 0.9]]))
    right = [(viterbi(c.scores(x), lengths, c.trans) == y).mean() for c in (crf, true)]
    assert right[0] > right[1] - 0.01 and right[0] > ((x[:, 0] == 2) == y).mean()
    assert Crf.fit(np.zeros((0, 1), int), np.zeros(0, int), np.zeros(0, int), 3).weights.tolist() == [0, 0, 0]
