import numpy as np
import pytest

from spectralmill.llm.clusters import describe_groups, similar_groups
from spectralmill.llm.graph_search import search_graph
from spectralmill.llm.neighbours import nearest_labels, neighbour_graph
from spectralmill.operators.vectors import latest_vectors

VEC = "label string, coords array<double>"


def truth(x, k, reach):
    names = sorted(x)
    out = {}
    for a in names:
        near = sorted((round(float(np.linalg.norm(np.array(x[a]) - np.array(x[b]))), 6), b) for b in names if b != a)
        out[a] = [(b, d) for d, b in near if d <= reach][:k]
    return out


def test_nearest_exact_on_small(frame):
    rng = np.random.default_rng(5)
    x = {f"v{i:03d}": rng.normal(size=4).round(1).tolist() for i in range(120)}
    x |= {f"c{i:02d}": [1.0, 2.0, 3.0, 4.0] for i in range(30)} | {"far": [90.0] * 4}
    got = {}
    for r in nearest_labels(frame(list(x.items()), VEC), 5, 1.5).orderBy("label", "rank").collect():
        got.setdefault(r.label, []).append((r.neighbour, r.distance))
    assert got == {k: v for k, v in truth(x, 5, 1.5).items() if v}


def test_descent_recall(frame):
    """Leaves far smaller than the clusters: the descent has to find what the forest cuts apart."""
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(6, 16)) * 5
    points = np.concatenate([c + rng.normal(size=(150, 16)) * 0.3 for c in centers])
    nodes = frame([(i, p.tolist()) for i, p in enumerate(points)], "id bigint, coords array<double>")
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(len(points)) for j in np.argsort(d[i])[:5]}
    found = {}
    for rounds in (0, 6):
        graph = neighbour_graph(nodes, k=10, trees=2, leaf=40, rounds=rounds)
        found[rounds] = len(want & {(r.id, r.nbr) for r in graph.collect()}) / len(want)
    assert found[6] >= 0.97 and found[6] > found[0]


def test_graph_search(frame):
    rng = np.random.default_rng(12)
    centers = rng.normal(size=(8, 6)) * 4
    points = np.concatenate([c + rng.normal(size=(60, 6)) * 0.4 for c in centers])
    asked = points[::7] + rng.normal(size=points[::7].shape) * 0.1
    nodes = frame([(i, p.tolist()) for i, p in enumerate(points)], "id bigint, coords array<double>")
    queries = frame([(i, q.tolist()) for i, q in enumerate(asked)], "query bigint, coords array<double>")
    found = search_graph(nodes, neighbour_graph(nodes, k=8, leaf=100), queries, 6, k=5)
    got = {(r.query, r.id) for r in found.collect()}
    d = np.linalg.norm(asked[:, None] - points[None], axis=2)
    want = {(i, int(j)) for i in range(len(asked)) for j in np.argsort(d[i])[:5]}
    assert len(got & want) / len(want) >= 0.95
    assert search_graph(nodes.limit(0), nodes.selectExpr("id", "id as nbr", "0.0D as d").limit(0), queries, 6).count() == 0


def test_nearest_edge_cases(frame):
    assert nearest_labels(frame([], VEC), 5, 1.5).count() == 0
    assert nearest_labels(frame([("a", [1.0, 2.0])], VEC), 5, 1.5).count() == 0
    two = nearest_labels(frame([("a", [1.0, 2.0]), ("b", [1.0, 2.0]), (None, [1.0, 2.0]), ("c", None)], VEC), 5, 1.5)
    assert sorted((r.label, r.neighbour, r.distance) for r in two.collect()) == [("a", "b", 0.0), ("b", "a", 0.0)]


def test_valid_vectors(frame):
    rows = [("a", [1.0, 2.0], 1), ('"a"', [3.0, 4.0], 2), ("b", [0.0, 0.0], 1), ("c", [1.0], 1), ("d", [float("nan"), 1.0], 1), ("e", [float("inf"), 1.0], 1), ("f", [None, 1.0], 1), (None, [1.0, 1.0], 1), ("g", None, 1), ("h", [-1.0, 0.0], None)]
    got = latest_vectors(frame(rows, "label string, coords array<double>, run_no int"), 2)
    assert {r.label: r.coords for r in got.collect()} == {"a": [3.0, 4.0], "h": [-1.0, 0.0]}


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(8)
    dims, x = 8, {}
    for g in range(12):
        center = rng.normal(size=dims) * 6
        for i in range(3 + 4 * (g % 4)):
            x[f"g{g:02d}_{i:02d}"] = (center + rng.normal(size=dims) * 0.08).tolist()
    x |= {f"near_{i}": (np.array(x["g03_00"]) + np.array([2.6] + [0.0] * 7) + rng.normal(size=dims) * 0.05).tolist() for i in range(6)}
    x |= {f"chain_{i}": (np.array([50.0] + [0.0] * 7) + np.array([1.2 * i] + [0.0] * 7)).tolist() for i in range(6)}
    x |= {f"copy_{i:03d}": [30.0] * dims for i in range(200)}
    return x


def test_clusters(frame, groups):
    names = sorted(groups)
    m = np.array([groups[n] for n in names])
    d = np.linalg.norm(m[:, None] - m[None], axis=2) <= 1.5
    want = set()
    for i in range(len(names)):
        members = np.flatnonzero(d[i])
        if len(members) >= 5 and all((d[j] == d[i]).all() for j in members):
            want |= {(names[members[0]], names[j]) for j in members}
    vectors = frame(list(groups.items()), VEC)
    result = similar_groups(vectors, 1.5, 8)
    found = result.where("mutual and size >= 5")
    assert {(r.comp, r.label) for r in found.collect()} == want
    chain = result.where("label like 'chain%'").collect()
    assert not any(r.mutual for r in chain)
    described = {r.comp: r for r in describe_groups(found, vectors, 1.5, 8).collect()}
    assert described["copy_000"]["size"] == 200 and described["copy_000"].typical == ["copy_000", "copy_001", "copy_002"]
    assert all(1 <= len(r.typical) <= 3 for r in described.values())


def test_clusters_empty(frame):
    assert similar_groups(frame([], VEC), 1.5, 8).count() == 0


def test_clusters_beside_a_wide_group(frame, monkeypatch):
    from spectralmill.llm import clusters

    monkeypatch.setattr(clusters, "BLOCK", 16)
    x = {f"a{i + 2:03d}": 0.9 * i for i in range(120)}  # one chained group, its center 53 away from its ends
    # beside each end the pivot of its cells, and five labels within reach of the end but not of the pivot
    x |= {"a000": 0.1, "a001": 0.9 * 119 - 0.1, "z0": x.pop("a002"), "z1": x.pop("a121")}
    x |= {f"b{i}": -1.49 - 0.001 * i for i in range(5)} | {f"c{i}": 0.9 * 119 + 1.49 + 0.001 * i for i in range(5)}
    x |= {f"d{i}": 200 + 0.01 * i for i in range(5)}
    got = {r.label: r.comp for r in similar_groups(frame([(n, [v] + [0.0] * 7) for n, v in x.items()], VEC), 1.5, 8).collect()}
    assert {got[n] for n in x if n[0] in "abcz"} == {"a000"} and {got[n] for n in x if n[0] == "d"} == {"d0"}


def test_touching_members_of_hot_cells(frame, spark, monkeypatch):
    """All groups with members within reach are found, whatever the size of a cell and of a group."""
    from spectralmill.llm import clusters
    from spectralmill.scratch import Scratch

    monkeypatch.setattr(clusters, "BLOCK", 16)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 6)) * 1.2
    comp = np.where(np.arange(400) < 150, 0, rng.integers(1, 120, 400))
    d = np.linalg.norm(x[:, None] - x[None], axis=2) <= 1.0
    want = {(f"c{min(comp[i], comp[j]):03d}", f"c{max(comp[i], comp[j]):03d}") for i, j in np.argwhere(d) if comp[i] != comp[j]}
    members = frame([(f"l{i:03d}", f"c{comp[i]:03d}", x[i].tolist()) for i in range(400)], "label string, comp string, coords array<double>")
    got = clusters._touching(members, 1.0, 16 / 3, 6, 4, Scratch(spark, "touching"))
    assert {tuple(sorted(r)) for r in got.collect()} == want


def test_groups_that_touch_away_from_their_pivots(frame):
    """Pairs of groups of which only two far members are within reach: none is a cluster."""
    rng = np.random.default_rng(1)
    x = {}
    for g in range(12):
        center, u = rng.normal(size=32) * 20, rng.normal(size=32)
        u /= np.linalg.norm(u)
        for h, s in ((0, -1), (1, 1)):
            for i in range(40):
                v = rng.normal(size=32)
                v -= v @ u * u
                v *= 0.4 * rng.random() / np.linalg.norm(v)
                x[f"p{g:02d}{h}{i:02d}"] = (center + u * s * 1.3 + v).tolist()
            x[f"p{g:02d}{h}99"] = (center + u * s * 0.70).tolist()
    m = np.array([x[n] for n in sorted(x)])
    assert (np.linalg.norm(m[:82, None] - m[None, :82], axis=2)[:41, 41:] <= 1.5).sum() == 1
    result = similar_groups(frame(list(x.items()), VEC), 1.5, 32)
    assert result.where("mutual").count() == 0 and result.select("comp").distinct().count() == 12


def test_clusters_of_balls_crowded_boxes_and_rounds(frame, monkeypatch):
    """Rows in balls, around balls, in plain boxes of several rounds and in crowded boxes give the groups of brute force."""
    from spectralmill.llm import boxes, clusters

    rng = np.random.default_rng(21)
    x = []
    for g in range(40):
        center, size = rng.normal(size=6) * 3, (90, 12, 6, 5, 1)[g % 5]
        x += [center + v for v in rng.normal(size=(size, 6)) * (0.12, 0.2, 0.1, 0.3, 0.1)[g % 5]]
        if g % 10 == 0:  # a row within reach of all, of some and of none of a ball's members
            x += [center + np.eye(6)[0] * d for d in (0.9, 1.5, 2.4)]
    x += list(np.array([25.0] * 6) + rng.normal(size=(500, 6)) * 0.6)  # one crowd, not mutual
    x = np.array(x)[rng.permutation(len(x))]
    names = [f"v{i:04d}" for i in range(len(x))]
    d = np.linalg.norm(x[:, None] - x[None], axis=2) <= 1.5
    want = set()
    for i in range(len(x)):
        members = np.flatnonzero(d[i])
        if len(members) >= 5 and (d[members] == d[i]).all():
            want |= {(names[members[0]], names[j]) for j in members}
    vectors = frame([(n, v.tolist()) for n, v in zip(names, x)], VEC)
    monkeypatch.setattr(clusters, "BLOCK", 24)
    monkeypatch.setattr(clusters, "BALL", 60)
    monkeypatch.setattr(clusters, "LEAST_ROUND", 1)
    seen = {}
    for crowd in (8, 1000):
        monkeypatch.setattr(clusters, "CROWD", crowd)
        found = similar_groups(vectors, 1.5, 6)
        seen[crowd] = {(r.comp, r.label, r.size) for r in found.collect()}
        assert {(r.comp, r.label) for r in found.where("mutual and size >= 5").collect()} == want
    assert seen[8] == seen[1000] and len(seen[8]) == len(x)
    balls = boxes.Balls(x, 1.5, 60, 3)
    assert len(balls.centers) and 0 < (balls.of(x)[0] >= 0).sum() < len(x)


def test_clusters_send_vectors_few_times(frame, spark):
    """What is shuffled is a few times the vectors, and its files go with each step."""
    rng = np.random.default_rng(22)
    centers = rng.normal(size=(700, 32)) * 2
    x = np.concatenate([c + rng.normal(size=(12, 32)) * 0.1 for c in centers])
    vectors = frame([(f"v{i:05d}", v.tolist()) for i, v in enumerate(x)], VEC)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList
    written = lambda: executors(False).apply(0).totalShuffleWrite()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = written()
    assert similar_groups(vectors, 1.5, 32).where("mutual and size >= 5").count() == len(x)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert written() - before < 4 * x.nbytes
