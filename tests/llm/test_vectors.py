from __future__ import annotations

import inspect
import tracemalloc

import numpy as np
import pytest

from tessera.llm import cover_tree
from tessera.llm.ann import CollisionIndex, nearest_neighbours

VECTORS = "vec_id long, embedding array<float>, label int, score double, node long"


@pytest.fixture(scope="module")
def table(spark):
    """Clusters, exact and scaled copies, ties, a hot label, and vectors that take no part."""
    r = np.random.default_rng(3)
    rows, centres = [], r.normal(size=(12, 16))
    for k in range(400):
        v = centres[k % 12] + r.normal(size=16) * (0.05, 0.2, 0.6)[k % 3]
        rows.append((k, v.astype(np.float32).tolist(), 0 if k % 3 else k % 4, 0.0, 1))
    rows += [(400 + k, rows[5][1], rows[5][2], 0.0, 1) for k in range(30)] + [(500, [2 * x for x in rows[5][1]], rows[5][2], 0.0, 1)]
    rows += [(600, None, 0, None, None), (601, [0.0] * 16, 0, None, None), (602, [float("nan")] + [1.0] * 15, 0, None, None), (603, [None] + [1.0] * 15, 0, None, None),
             (604, [], 0, None, None), (605, [1.0] * 8, 0, None, None), (606, rows[5][1], None, None, None), (607, [float("inf")] + [1.0] * 15, 0, None, None)]
    return spark.createDataFrame(rows, VECTORS), rows


def usable(v):
    return v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("block,turns", [(64, 8), (16, 1), (3072, 8)])
def test_links_and_components(spark, table, monkeypatch, block, turns):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    monkeypatch.setattr(cover_tree, "TURNS", turns)
    monkeypatch.setattr(cover_tree, "PART", 100)
    df, rows = table
    ok = [r for r in rows if usable(r[1]) and r[2] is not None]
    x = np.array([r[1] for r in ok], np.float64)
    norm = np.sqrt((x * x).sum(1))
    link = ((x @ x.T) / norm[:, None] / norm[None] >= 0.93) & (np.array([r[2] for r in ok])[:, None] == np.array([r[2] for r in ok])[None])
    np.fill_diagonal(link, False)
    component = np.array([r[0] for r in ok])
    while True:
        new = np.minimum(component, np.where(link, component[None], 10**9).min(1))
        if (new == component).all():
            break
        component = new
    want = {r[0]: (0, r[0], True) for r in rows} | {r[0]: (int(link[k].sum()), int(component[k]), component[k] == r[0]) for k, r in enumerate(ok)}
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in cover_tree.near_duplicate_vectors(df).collect()}
    assert got == want


def test_no_pair_at_the_threshold_is_pruned():
    """x lies 5e-4 from its centre c and just within reach of y, c just beyond: c's covering radius must not round to less."""
    r, reach = np.random.default_rng(8), np.sqrt(2 - 2 * 0.93)
    for _ in range(400):
        c, side = np.linalg.qr(r.normal(size=(64, 2)))[0].T
        at = lambda angle, c=c, side=side: np.cos(angle) * c + np.sin(angle) * side
        y = at(2 * np.arcsin((reach + 4.5e-4) / 2))
        x = at(5e-4)
        assert x @ y >= 0.93 > c @ y
        trees = cover_tree.CoverTree.build(np.stack([c, x]), reach / 2), cover_tree.CoverTree.build(y[None], reach / 2)
        assert any(1 in xs for xs, *_ in cover_tree.close_pairs(*trees, reach))


@pytest.mark.parametrize("n,noise", [(1, 0.1), (300, 0.01), (500, 0.06), (400, 1.0)])
def test_a_cover_tree_nests_covers_and_separates(n, noise):
    r = np.random.default_rng(4)
    v = r.normal(size=(8, 12))[r.integers(0, 8, n)] + r.normal(size=(n, 12)) * noise
    v = np.concatenate([v, v[: n // 10] * 3.0])  # of one direction
    unit = v / np.sqrt((v * v).sum(1))[:, None]
    tree = cover_tree.CoverTree.build(unit, 0.18)
    again = cover_tree.CoverTree.load(unit, tree.dump())
    radius = 2.0
    for level, centre in enumerate(tree.centre):
        gap = np.sqrt(((unit[centre][:, None] - unit[centre][None]) ** 2).sum(2))
        np.fill_diagonal(gap, np.inf)
        assert (gap > radius - 1e-6).all() or len(centre) == 1
        assert sorted(np.concatenate(tree.members[level]).tolist()) == list(range(len(unit)))
        for c, members, far in zip(centre, tree.members[level], tree.far[level]):
            d = np.sqrt(((unit[members] - unit[c]) ** 2).sum(1))
            assert c in members and abs(d.max() - far) < 1e-12 and far <= 2 * radius + 1e-6
        if level:
            above = tree.centre[level - 1]
            assert set(above) <= set(centre)
            assert (np.sqrt(((unit[centre] - unit[above][tree.parent[level]]) ** 2).sum(1)) <= 2 * radius + 1e-6).all()
        assert (again.far[level] == tree.far[level]).all() and (again.below[level] == tree.below[level]).all()
        radius /= 2


def test_links_just_above_the_threshold_between_near_equal_vectors(spark):
    """Labels of three vectors: m 4e-4 from its centre, the third at a cosine of 0.93001 to m."""
    r, rows = np.random.default_rng(12), []
    for label in range(120):
        c, side = np.linalg.qr(r.normal(size=(64, 2)))[0].T
        at = lambda angle, c=c, side=side: (np.cos(angle) * c + np.sin(angle) * side).astype(np.float32)
        rows += [(3 * label + k, v.tolist(), label, 0.0, 1) for k, v in enumerate((at(0.0), at(4e-4), at(4e-4 + np.arccos(0.93001))))]
    got = {x["vec_id"]: x["n_links"] for x in cover_tree.near_duplicate_vectors(spark.createDataFrame(rows, VECTORS)).collect()}
    want = {}
    for k in range(0, len(rows), 3):
        x = np.array([v for _, v, *_ in rows[k : k + 3]], np.float64)
        norm = np.sqrt((x * x).sum(1))
        link = (x @ x.T) / norm[:, None] / norm[None] >= 0.93
        want |= {k + i: int(link[i].sum()) - 1 for i in range(3)}
    assert got == want and sum(want.values()) >= 480


def test_blocks_that_lie_apart_never_meet(spark, monkeypatch):
    """A label of 40 tight clusters: each is parted off, and covering radii prune almost all pairs of blocks."""
    monkeypatch.setattr(cover_tree, "BLOCK", 64)
    r = np.random.default_rng(13)
    centres = r.normal(size=(40, 32))
    rows = [(k, (centres[k % 40] + r.normal(size=32) * 0.02).tolist(), 1, 0.0, 1) for k in range(1600)]
    df = spark.createDataFrame(rows, VECTORS)
    distinct = df.selectExpr("label", "embedding AS v", "vec_id AS node", "CAST(1 AS long) AS m", "size(embedding) AS dim")
    blocks = cover_tree.planted(distinct, np.sqrt(2 - 2 * 0.93))
    n = blocks.count()
    assert n >= 25 and cover_tree.touching(blocks, np.sqrt(2 - 2 * 0.93)).count() < 0.1 * n * n / 2 + n
    got = cover_tree.near_duplicate_vectors(df).groupBy("n_links").count().collect()
    assert [(x["n_links"], x["count"]) for x in got] == [(39, 1600)]


@pytest.mark.parametrize("noise", [0.012, 0.03, 0.035])
def test_a_large_noisy_group_stays_in_bounded_memory(noise):
    """Cosines to the centre about 0.995, 0.97 and 0.95: leaves that link as a whole, and pairs on both sides of the threshold."""
    r, reach, n = np.random.default_rng(9), np.sqrt(2 - 2 * 0.93), 2500
    v = r.normal(size=64) / 8 + r.normal(size=(n, 64)) * noise
    m = r.integers(1, 4, n)
    tracemalloc.start()
    seen = cover_tree.Links(v, m, 0.93)
    for half in (slice(None), slice(0, n // 2)):
        seen.links[:], seen.found = 0, []
        trees = [cover_tree.CoverTree.build(seen.unit[half], reach / 2)]
        trees.append(trees[0] if half == slice(None) else cover_tree.CoverTree.build(seen.unit[n // 2 :], reach / 2))
        for xs, ys, sure in cover_tree.close_pairs(*trees, reach):
            (seen.all if sure else seen.check)(xs, ys if trees[0] is trees[1] else ys + n // 2)
        link = seen.unit @ seen.unit.T >= 0.93
        np.fill_diagonal(link, False)
        if trees[0] is not trees[1]:
            link[: n // 2, : n // 2] = link[n // 2 :, n // 2 :] = False
        assert (seen.links == link @ m).all()
        x, y = np.nonzero(link)
        assert [z.tolist() for z in cover_tree.forest(x, y)] == [z.tolist() for z in cover_tree.forest(*np.concatenate(seen.found, 1))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1e9


def test_neighbours_recall(spark, table):
    df, rows = table
    ok = [r for r in rows if usable(r[1])]
    ids, x = np.array([r[0] for r in ok]), np.array([r[1] for r in ok], np.float64)
    found = {}
    for r in nearest_neighbours(df, df.where("vec_id % 10 = 0")).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(found[r["query_id"]])
    hits = total = 0
    for q in ids[ids % 10 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        order = np.lexsort((ids, d))[:10]
        assert found[q] == sorted(found[q]) and len(found[q]) == 10 and q not in {v for _, v in found[q]}
        for s, v in found[q]:
            assert s == d[ids == v][0]
        hits += sum(s <= d[order[-1]] for s, _ in found[q])
        total += 10
    assert hits / total >= 0.9
    assert not {600, 601, 602, 603, 604, 607} & {v for f in found.values() for _, v in f}


def test_recall_and_verified_share_of_the_table():
    """Whole sf0.1 table: nine in ten of the nearest are found although under three in ten vectors are verified."""
    import pyarrow.parquet as pq

    x = np.array(pq.read_table("/root/testdata/sf0.1/embeddings.parquet")["embedding"].to_pylist(), np.float64)
    options = {k: p.default for k, p in inspect.signature(nearest_neighbours).parameters.items() if k in ("projections", "share", "growth", "seed")}
    index, hits, verified = CollisionIndex(x, **options), 0, 0
    for q in range(0, len(x), 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        rows, dist = index.search(x[q], 10, np.arange(len(x)) == q)
        assert (d[rows] == dist).all() and len(rows) == len(set(rows.tolist()))
        hits += (np.sort(dist)[:10] <= np.sort(d)[9]).sum()
        verified += len(rows)
    assert hits >= 9 * 20 and verified < 0.3 * 20 * len(x)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_over_many_queries(sf):
    """The registered queries, and 200 rows as queries: at least nine in ten of the ten nearest are found in both."""
    import pyarrow.parquet as pq

    t = pq.read_table(f"/root/testdata/{sf}/embeddings.parquet")
    ids, x = t["vec_id"].to_numpy(), np.array(t["embedding"].to_pylist(), np.float64)
    options = {k: p.default for k, p in inspect.signature(nearest_neighbours).parameters.items() if k in ("projections", "share", "growth", "seed")}
    index = CollisionIndex(x, **options)

    def recall(rows):
        hits = 0
        for q in rows:
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
            d[q] = np.inf
            _, dist = index.search(x[q], 10, np.arange(len(x)) == q)
            hits += (np.sort(dist)[:10] <= np.sort(d)[9]).sum()
        return hits / 10 / len(rows)

    assert recall(np.flatnonzero(ids % 100 == 0)) >= 0.9
    assert recall(range(0, len(x), max(1, len(x) // 200))) >= 0.95


def test_counts_go_on_from_radius_to_radius():
    """Windows that grow in steps count each vector once for each array, as one window of the last radius does."""
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 8))
    x[50:60] = x[40]  # ties in every array
    for growth in (1.02, 3.0):
        index = CollisionIndex(x, 32, 0.65, growth, 11)
        for q in (0, 45, 299):
            rows, dist = index.search(x[q], 5, np.arange(300) == q)
            others = index.spread[index.spread != q]
            radius = 0.75 * np.sqrt(((x[others] - x[q]) ** 2).sum(1)).min()
            radius = max(radius, 1e-9)
            while True:
                times = (np.abs((x - x[q]) @ index.axes) <= radius + 1e-9).sum(1)
                inside = {int(k) for k in np.flatnonzero(times >= index.need)} - {q}
                if len(inside) == 299 or sum(index.margin * np.sqrt(((x[k] - x[q]) ** 2).sum()) <= radius for k in inside) >= 5:
                    break
                radius *= growth
            assert set(rows.tolist()) == inside


def test_few_repeated_and_no_vectors(spark):
    rows = [(1, [1.0, 0.0], 1, None, None)] * 2 + [(2, [0.0, 1.0], 1, None, None), (3, [1.0, 1.0], 1, None, None)]
    df = spark.createDataFrame(rows, VECTORS)
    got = nearest_neighbours(df, df.where("vec_id = 1")).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 3), (2, 2)]
    none = spark.createDataFrame([], VECTORS)
    assert nearest_neighbours(none, none).count() == 0 and nearest_neighbours(df, none).count() == 0
    assert cover_tree.near_duplicate_vectors(none).count() == 0
    twice = cover_tree.near_duplicate_vectors(df).where("vec_id = 1").collect()
    assert [(r["n_links"], r["component_id"]) for r in twice] == [(1, 1), (1, 1)]
