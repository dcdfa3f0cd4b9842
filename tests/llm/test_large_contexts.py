"""A context of many strings is worked on in cuts that give what the whole gives."""

import numpy as np

from doorstep.llm import lmscore


def test_large_context_in_cuts(monkeypatch):
    rng = np.random.default_rng(7)
    h = np.unique(rng.integers(0, 40, 4000) << 32 | rng.integers(0, 6, 4000) << 24 | rng.integers(97, 123, 4000)) | 0x6520 << 40
    c = rng.integers(0, 9, len(h))
    sizes, made = [], lmscore.Subtrees.__init__
    monkeypatch.setattr(lmscore.Subtrees, "__init__", lambda self, x, *more: (sizes.append(len(x)), made(self, x, *more))[1])
    whole = lmscore.Contexts(h, c, True)
    tops = [(np.full(1 << n, 0.4), np.full(1 << n, 0.3)) for n in (16, 8)]
    assert sizes == [len(h)]
    direct = lmscore.Subtrees(h, c, lmscore.TOP)
    code, names, n0, n1, mix, _ = direct.levels[lmscore.TOP]
    order = np.argsort(names)
    assert (whole.names == names[order]).all() and (whole.n0 == n0[order]).all() and np.allclose(whole.mix, mix[order])
    assert np.allclose(whole.scores([]), np.log10(direct.probabilities()).reshape(-1, 8).sum(axis=1))
    sizes.clear()
    monkeypatch.setattr(lmscore, "STRINGS", 500)
    cut = lmscore.Contexts(h, c, True)
    assert len(sizes) > 5 and max(sizes) <= 500 and sum(sizes) == len(h)
    assert np.allclose(cut.mix, whole.mix) and np.allclose(cut.scores(tops), whole.scores(tops))


def test_lists_are_folded_by_merging():
    keys, counts = lmscore._folded([np.array([-5, 2, 9]), np.array([2, 9, 11])], [np.array([1, 2, 3], np.int32), np.array([10, 20, 30])])
    assert keys.tolist() == [-5, 2, 9, 11] and counts.tolist() == [1, 12, 23, 30]
    known, codes = lmscore.merged([(np.array([-5, 2]), np.array([0, 1, 1])), (np.array([2, 7]), np.array([1, 0]))])
    assert known.tolist() == [-5, 2, 7] and [x.tolist() for x in codes] == [[0, 1, 1], [2, 1]]
