"""Ranks and bit-sliced window matches against counting."""

import numpy as np
import pytest

from regseq.functions import ranks


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_ranks(n):
    marked = np.random.default_rng(n).random(n) < 0.3
    assert (ranks.Ranks(marked)(np.arange(n + 1)) == np.concatenate([[0], np.cumsum(marked)])).all()


def test_shares():
    s = ranks.Shares("ANNT", "ACNTG")
    assert s(np.array([0, 1, 2, 3]), 2).tolist() == [50.0, 50.0, 0.0, 0.0]
    assert ranks.Shares(None, "ACNT")(np.array([0]), 2).tolist() == [0.0]


def plain(x, y, width, cutoff):
    same = (x[:, None] == y[None, :]) & (x != ord("N"))[:, None]
    sums = np.zeros((len(x) + 1, len(y) + 1), int)
    for i in range(len(x)):
        sums[i + 1, 1:] = sums[i, :-1] + same[i]
    score = sums[width:, width:] - sums[:-width, :-width]
    i, j = np.nonzero(score >= cutoff)
    return sorted(zip(i.tolist(), j.tolist(), score[i, j].tolist(), strict=True))


def found(x, y, width, cutoff):
    return sorted(t for part in ranks.window_matches(x, y, width, cutoff) for t in zip(*(a.tolist() for a in part), strict=True))


@pytest.mark.parametrize("size", [(5, 300, 20), (100, 130, 20), (64, 64, 20), (300, 200, 60), (65, 127, 64), (20, 20, 20), (128, 500, 7), (150, 700, 130), (400, 330, 300), (200, 90, 1)])
def test_window_matches(size, monkeypatch):
    n, m, width = size
    r = np.random.default_rng(n)
    x, y = (np.frombuffer(a, np.uint8)[r.integers(0, len(a), k)] for a, k in ((b"ACGTN", n), (b"ACGTNx", m)))
    core = min(n, m, 90) // 2
    y = y.copy()
    y[-core:] = x[:core]
    for cutoff in (0, 1, width // 4, width // 2, width):
        for words, candidates in ((1 << 17, 1 << 16), (7, 16)):
            monkeypatch.setattr(ranks, "WORDS", words)
            monkeypatch.setattr(ranks, "CANDIDATES", candidates)
            want = plain(x, y, width, cutoff) if min(n, m) >= width else []
            assert found(x, y, width, cutoff) == want


def test_work_falls_as_the_cutoff_rises(monkeypatch):
    """Fewer windows are scored base by base where the cutoff is higher."""
    r = np.random.default_rng(1)
    x, y = (np.frombuffer(b"ACGT", np.uint8)[r.integers(0, 4, 1500)] for _ in range(2))
    scored = []
    unpack = np.unpackbits
    monkeypatch.setattr(np, "unpackbits", lambda a, **k: scored.append(a.size) or unpack(a, **k))
    work = []
    for cutoff in (15, 25, 35, 45):
        scored.clear()
        found(x, y, 60, cutoff)
        work.append(sum(scored))
    assert work[0] > work[1] > work[2] > work[3] and work[3] < work[0] / 100
