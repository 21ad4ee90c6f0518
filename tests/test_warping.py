import numpy as np
import pytest

from tessitura.functions import warping
from tessitura.functions.warping import Warp


def plain(x, y, band=None, local=False, open_ends=False):
    n, m = len(x), len(y)
    band = max(n, m) if band is None else max(band, abs(n - m))
    d = {}
    for i in range(n):
        for j in range(m):
            if abs(i - j) > band:
                continue
            c = (x[i] - y[j]) ** 2
            if (i, j) == (0, 0) or open_ends and 0 in (i, j):
                d[i, j] = c
                continue
            steps = [(i - 2, j - 1), (i - 1, j - 1), (i - 1, j - 2)] if local and i > 1 and j > 1 else [(i - 1, j - 1), (i - 1, j), (i, j - 1)]
            d[i, j] = c + min((d.get(s, np.inf) for s in steps), default=np.inf)
    if not open_ends:
        return d[n - 1, m - 1]
    return min(v for (i, j), v in d.items() if (i == n - 1 and j >= m - 1 - band) or (j == m - 1 and i >= n - 1 - band))


@pytest.mark.parametrize("warp", [Warp(), Warp(band=2), Warp(band=3, local=True), Warp(band=2, open_ends=True), Warp(band=4, local=True, open_ends=True)])
@pytest.mark.parametrize("sizes", [(9, 9), (7, 10), (1, 4)])
def test_distances(warp, sizes):
    rng = np.random.default_rng(sum(sizes))
    x, y = rng.standard_normal((20, sizes[0])), rng.standard_normal((20, sizes[1]))
    want = [plain(a, b, warp.band, warp.local, warp.open_ends) for a, b in zip(x, y, strict=True)]
    assert warping.distances(x, y, warp) == pytest.approx(want)


def test_known_value():
    assert warping.distances(np.array([[0.0, 1, 2, 3]]), np.array([[0.0, 2, 2, 5]]), Warp(band=1))[0] == 5.0


def test_bounds_symmetry_and_band():
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((200, 16)).cumsum(axis=1), rng.standard_normal((200, 16)).cumsum(axis=1)
    narrow, wide = (warping.distances(x, y, Warp(band=b)) for b in (2, 6))
    assert (wide <= narrow + 1e-9).all()
    assert warping.distances(y, x, Warp(band=2)) == pytest.approx(narrow)
    assert (warping.keogh(*warping.envelope(x, 2), y) <= narrow + 1e-9).all()
    assert (warping.cost(x[:, 0], y[:, 0], "sq_euclidean") + warping.cost(x[:, -1], y[:, -1], "sq_euclidean") <= narrow + 1e-9).all()


def test_path_costs_its_distance():
    rng = np.random.default_rng(2)
    for warp in (Warp(), Warp(band=3), Warp(band=3, local=True)):
        x, y = rng.standard_normal((1, 12)), rng.standard_normal((1, 12))
        costs = warping.matrices(x, y, warp)
        dist, i, j = warping.ends(costs, warp)
        cells = warping.path(costs[:, :, 0], (int(i[0]), int(j[0])), warp)
        assert cells[0] == (0, 0) and cells[-1] == (11, 11)
        assert warping.distance_along(x[0], y[0], cells) == pytest.approx(dist[0])


def test_envelope_against_plain_windows():
    x = np.random.default_rng(3).standard_normal((3, 20))
    high, low = warping.envelope(x, 4)
    for i in range(20):
        part = x[:, max(0, i - 4) : i + 5]
        assert (high[:, i] == part.max(axis=1)).all() and (low[:, i] == part.min(axis=1)).all()
