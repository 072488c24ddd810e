"""Meetings of blocks of the exact search."""
import tracemalloc

import numpy as np
import pytest

from skychan.llm.segment_topk import meet


@pytest.mark.parametrize("scale", [3, 400, 1 << 26])
def test_meeting_by_brute_force(scale):
    """Ties, ids that are queries and candidates, and products that floats don't hold."""
    g = np.random.default_rng(4)
    v = np.floor(g.normal(size=(300, 12)) * scale).astype("<i8")
    v[100:110] = v[5]
    ids = g.permutation(300)
    qi, vi, score, _ = meet(v[:40], ids[:40], v, ids, 5)
    want = [(i, j, s) for i in range(40) for s, j in [(-a, j) for a, _, j in sorted((-int(sum(int(x) * int(y) for x, y in zip(v[i], v[j], strict=True))), int(ids[j]), j) for j in range(300) if j != i)[:5]]]
    assert list(zip(qi.tolist(), vi.tolist(), score.tolist(), strict=True)) == want
    assert len(meet(v[:1], ids[:1], v[:1], ids[:1], 5)[0]) == 0


def test_memory_of_a_meeting():
    """Where bounds leave most pairs, their vectors are not copied pair by pair."""
    g = np.random.default_rng(5)
    v = np.floor(g.normal(size=(2048, 64)) * 256).astype("<i8")
    tracemalloc.start()
    *_, exact = meet(v[:512], np.arange(512), v, np.arange(2048), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert exact > 500_000 and peak < 100_000_000
