"""Metric-pruned nearest neighbours against brute force."""

import numpy as np
import pytest

from tidewater.operators import neighbours
from tidewater.operators.neighbours import nearest_neighbours


def brute(rows, k):
    """id -> [(neighbour, distance)] by comparing all pairs; ties to the smaller id."""
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], float)
    out = {}
    for a, i in enumerate(ids):
        d = np.sqrt(((x - x[a]) ** 2).sum(1))
        out[i] = sorted(((dist, j) for j, dist in zip(ids, d) if j != i))[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r[0], r["rank"])):
        out.setdefault(r[0], []).append((r["distance"], r["neighbour"]))
        assert r["rank"] == len(out[r[0]])
    return out


def same(got, want):
    assert set(got) == {i for i, n in want.items() if n}
    for i, n in want.items():
        assert [j for _, j in got.get(i, [])] == [j for _, j in n], i
        assert [d for d, _ in got.get(i, [])] == pytest.approx([d for d, _ in n], abs=1e-9)


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim)) * 8
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * rng.choice([0.1, 1.0], n)[:, None]
    return [(i, x[i].tolist()) for i in range(n)]


@pytest.mark.parametrize("n,dim,block_rows", [(60, 2, 512), (700, 3, 16), (2500, 6, 32)])
def test_same_neighbours_as_all_pairs(spark, n, dim, block_rows):
    rows, stats = clustered(n, dim, n), {}
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(4)
    same(found(nearest_neighbours(df, k=5, block_rows=block_rows, stats=stats)), brute(rows, 5))
    assert stats["rows"] == n and (n < 100 or stats["skipped"] > 0.5)


def test_twins_ties_and_grids(spark):
    """Equal rows, rows at equal distances, -0.0, and a group of twins larger than k with members beyond the k-th."""
    rows = [(i, [float(i % 7), float(i // 7 % 7)]) for i in range(98)] + [(100 + i, [3.0, 3.0]) for i in range(40)]
    rows += [(200, [0.0, 50.0]), (201, [-0.0, 50.0]), (202, [0.0, 51.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    for block_rows in (4, 512):
        same(found(nearest_neighbours(df, k=4, block_rows=block_rows)), brute(rows, 4))


def test_dense_cell_and_busy_cell_are_cut(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "VISIT_ROWS", 50)
    monkeypatch.setattr(neighbours, "STRIP", 16)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(600, 3)) * 1e-3, rng.normal(size=(60, 3)) * 5 + 20])
    rows = [(f"r{i}", x[i].tolist()) for i in range(len(x))]
    df = spark.createDataFrame(rows, "key string, vec array<double>").repartition(4)
    got = found(nearest_neighbours(df, k=3, id_col="key", vec_col="vec", block_rows=20, max_cells=4))
    same(got, brute(rows, 3))


def test_large_offsets_do_not_lose_neighbours(spark):
    """Coordinates far from the origin: rounding of lower bounds and products."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 4)) + 1e6
    rows = [(i, x[i].tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    same(found(nearest_neighbours(df, k=5, block_rows=16)), brute(rows, 5))


def test_odd_rows(spark):
    schema = "id long, vector array<double>"
    rows = [(1, [0.0]), (2, [1.0]), (3, None), (None, [1.0]), (4, [float("nan")]), (5, [None]), (6, [float("inf")]), (7, [])]
    got = found(nearest_neighbours(spark.createDataFrame(rows, schema), k=5))
    assert got == {1: [(1.0, 2)], 2: [(1.0, 1)]}
    assert nearest_neighbours(spark.createDataFrame([], schema), k=5).count() == 0
    assert nearest_neighbours(spark.createDataFrame([(1, [0.0])], schema), k=5).count() == 0
    assert found(nearest_neighbours(spark.createDataFrame([(i, [2.0]) for i in range(3)], schema), k=1)) == {0: [(0.0, 1)], 1: [(0.0, 0)], 2: [(0.0, 0)]}


def test_bounds_never_exceed_distances():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 5)) * rng.choice([0.1, 3], 5)
    centre = neighbours.fit_centres(x, 20, 1)
    pivot = neighbours.far_apart(centre, 4)
    square = neighbours._square(x, centre)
    home = square.argmin(1)
    away = np.sqrt(neighbours._square(x, pivot))
    part = [home == c for c in range(len(centre))]
    cells = neighbours.Cells(centre, pivot, np.array([np.sqrt(square[m, c]).max() if m.any() else -1 for c, m in enumerate(part)]),
                             np.array([away[m].min(0) if m.any() else np.zeros(4) for m in part]),
                             np.array([away[m].max(0) if m.any() else np.zeros(4) for m in part]), 10.0)
    bound = neighbours.lower_bounds(x, home, cells)
    for c, m in enumerate(part):
        if m.any():
            nearest = np.sqrt(((x[:, None] - x[m][None]) ** 2).sum(2)).min(1)
            assert (bound[:, c] <= nearest + 1e-9).all()
        else:
            assert np.isinf(bound[:, c]).all()


def test_rows_alone_in_their_cell_and_a_centre_without_rows(spark, monkeypatch):
    """A row without a bound visits every cell that holds rows, and none that holds none."""
    rows = [(i, [float(i), 0.0]) for i in range(40)]
    fitted = neighbours._fitted

    def with_empty_cell(*a):
        centre, pivot = fitted(*a)
        return np.vstack([centre, [[1e6, 1e6]]]), pivot

    monkeypatch.setattr(neighbours, "_fitted", with_empty_cell)
    stats: dict = {}
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(2)
    same(found(nearest_neighbours(df, k=3, block_rows=2, stats=stats)), brute(rows, 3))
    assert 0 <= stats["pairs_skipped"] <= 1


def test_a_row_goes_to_a_bundle_of_cells_once(spark):
    """Where nothing can be pruned, what is stored and shuffled follows the bundles, not the cells."""
    from tidewater import session
    rng = np.random.default_rng(12)
    x = rng.normal(size=(600, 12))
    rows, stats, seen = [(i, x[i].tolist()) for i in range(600)], {}, {}
    session.stage_observers.append(lambda name, df: seen.update({name: df.count()} if name == "nn-visits" else {}))
    try:
        near = nearest_neighbours(spark.createDataFrame(rows, "id long, vector array<double>").repartition(4), k=3, block_rows=4, stats=stats)
        same(found(near), brute(rows, 3))
    finally:
        session.stage_observers.pop()
    assert stats["cells"] > 100 and stats["skipped"] < 0.5
    assert seen["nn-visits"] <= 600 * 40


def test_bundles_hold_neighbouring_cells_of_bounded_size():
    centre = np.array([[float(i), 0.0] for i in range(10)])
    got = neighbours.bundles(centre, {i: 10 for i in range(9)} | {9: 500}, 30)
    assert all(sum((got == b)[:9]) <= 3 for b in set(got)) and sum(got == got[9]) == 1
    assert (np.diff(got) >= 0).all()


def test_bounds_within_reach_are_the_same_in_any_strips():
    """A cell that a row's reach allows has the bound it has without a reach; none that it allows is lost."""
    import numpy as np
    from tidewater.operators import neighbours as N
    rng = np.random.default_rng(3)
    rows = rng.random((700, 4))
    centre = N.fit_centres(rows, 60, 1)
    pivot, home = N.far_apart(centre, 8), N._square(rows, centre).argmin(1)
    out, to = np.sqrt(N._square(rows, centre))[np.arange(700), home], np.sqrt(N._square(rows, pivot))
    of = lambda f, v: np.stack([f(v[home == c], axis=0) for c in range(len(centre))])
    cells = N.Cells(centre, pivot, of(np.max, out), of(np.min, to), of(np.max, to), 3.0, of(np.min, rows), of(np.max, rows))
    whole = N.lower_bounds(rows, home, cells)
    reach = np.where(np.arange(700) % 50 == 0, np.inf, 0.12)
    was = N.BOUND_VALUES
    try:
        for N.BOUND_VALUES in (1, 4000, 1 << 30):
            near = N.lower_bounds(rows, home, cells, reach=reach)
            slack = (reach + N._SLACK * cells.scale)[:, None]
            assert ((near <= slack) == (whole <= slack)).all() and np.allclose(np.where(whole <= slack, near, 0), np.where(whole <= slack, whole, 0))
    finally:
        N.BOUND_VALUES = was
    assert (whole > 0.12).mean() > 0.5
