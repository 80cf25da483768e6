import numpy as np
import pytest

from spectralmill.errors import IncompatibleGeometries, InvalidKeepAtMost, InvalidThreshold, NegativePower, UnknownDistance, UnknownMetric
from spectralmill.functions.space import Distance, Metric
from spectralmill.operators import distances, embeddings, splits

VEC = "label string, coords array<double>"
#: fixed values: a worked row of ten distances; its mean, deviation, median, MAD; its two nearest with z-scores
WORKED = (
    [3.298234166382, 3.33901585931896, 1.85388698190156, 3.35586331250312, 3.35677089495605, 3.35069768834933, 3.31043491848486, 3.30792669036762, 3.32894004017435, 3.31694544810727],
    (3.18187160005451, 0.467075454492746, 3.32894004017435, 0.0217576481749768),
    [(1.85388698190156, -2.84319076367473), (3.298234166382, 0.249130124925674)],
)


def test_parsing():
    assert str(Distance.parse("minkowski(3)")) == "minkowski(3)" and Distance.parse("cosine").exponent == 2
    assert str(Metric.parse("powers(1,0.5,2)")) == "powers(1,0.5,2)"
    for bad, error in (("manhattan", UnknownDistance), ("minkowski(x)", UnknownDistance), ("minkowski(-1)", NegativePower)):
        with pytest.raises(error):
            Distance.parse(bad)
    for bad, error in (("cube", UnknownMetric), ("powers(1,2,1)", InvalidThreshold), ("powers(-1,1,1)", NegativePower)):
        with pytest.raises(error):
            Metric.parse(bad)


def test_metric(frame):
    inertia = frame([(1, "Dim1", 0.5), (2, "Dim2", 0.3), (3, "Dim3", 0.2)], "dim int, name string, value double")
    assert embeddings.metric_vector(inertia, Metric.parse("flat")) == pytest.approx([1 / 3] * 3)
    assert embeddings.metric_vector(inertia, Metric.parse("powers(1,0.6,2)")) == pytest.approx([0.25 / 0.34, 0.09 / 0.34, 0])
    assert [r.weight for r in embeddings.metric_table(inertia, Metric.parse("powers(1,0.6,2)")).orderBy("dim").collect()] == pytest.approx([0.25 / 0.34, 0.09 / 0.34, 0])


@pytest.mark.parametrize("kind", ["euclidean", "cosine", "minkowski(1)", "minkowski(3)"])
@pytest.mark.parametrize("normalise", [True, False])
def test_cross(frame, kind, normalise):
    rng = np.random.default_rng(1)
    a, b, w = rng.normal(size=(7, 4)), rng.normal(size=(5, 4)), np.array([0.4, 0.3, 0.2, 0.1])
    a[3] = 0
    d = Distance.parse(kind)

    def scale(t):
        return t / 2 if kind == "cosine" else t ** (1 / d.exponent)

    def unit(x):
        n = scale((np.abs(x) ** d.exponent * w).sum(1))
        return x / np.where(n == 0, 1, n)[:, None] if normalise else x

    want = scale((np.abs(unit(a)[:, None] - unit(b)[None]) ** d.exponent * w).sum(2))
    fa, fb = (frame([(f"{n}{i}", row.tolist()) for i, row in enumerate(x)], VEC) for n, x in (("a", a), ("b", b)))
    got = {(r.row_label, r.col_label): r.distance for r in distances.cross_distances(fa, fb, list(w), d, normalise).collect()}
    assert got == {(f"a{i}", f"b{j}"): pytest.approx(want[i, j]) for i in range(7) for j in range(5)}


def test_empty_and_mismatch(frame):
    one, none = frame([("a", [1.0, 2.0])], VEC), frame([], VEC)
    assert distances.cross_distances(one, none, [0.5, 0.5]).count() == 0
    assert distances.summarise_rowwise(one, none, [0.5, 0.5]).count() == 0
    with pytest.raises(IncompatibleGeometries):
        distances.cross_distances(one, one, [1.0])
    with pytest.raises(InvalidKeepAtMost):
        distances.summarise_rowwise(one, one, [0.5, 0.5], keep=0)


def test_worked_summary(frame):
    values = WORKED[0]
    table = frame([("121", str(i + 1), v) for i, v in enumerate(values)], "row_label string, col_label string, distance double")
    got = distances.summarise_distances(table).first()
    assert (got.mean, got.stddev, got.median, got.mad) == pytest.approx(WORKED[1])
    assert [(n.distance, n.z) for n in got.neighbours] == [pytest.approx(x) for x in WORKED[2]]


def test_ties_and_agreement(frame):
    points = frame([("p", [0.0]), ("q", [5.0])], VEC)
    others = frame([(n, [x]) for n, x in (("a", 1.0), ("b", -1.0), ("c", 1.0), ("d", 4.0), ("e", 9.0))], VEC)
    fused = {r.label: r for r in distances.summarise_rowwise(points, others, [1.0], normalise=False).collect()}
    assert [n.label for n in fused["p"].neighbours] == ["a", "b", "c"] and fused["p"].median == 1.0 and fused["p"].mad == 0.0
    sorted_ = {r.label: r for r in distances.summarise_distances(distances.cross_distances(points, others, [1.0], normalise=False)).collect()}
    for k in fused:
        assert [tuple(n) for n in fused[k].neighbours] == [pytest.approx(tuple(n)) for n in sorted_[k].neighbours]
        assert (fused[k].mean, fused[k].stddev, fused[k].mad) == pytest.approx((sorted_[k].mean, sorted_[k].stddev, sorted_[k].mad))


def test_spectral(frame):
    cells = frame([("a", "x", 1), ("a", "y", 3), ("b", "y", 2), ("c", "z", 5)], "label string, kmer string, count bigint")
    labels = cells.select("label").distinct()
    share = {"a": np.array([0.25, 0.75, 0]), "b": np.array([0, 1.0, 0]), "c": np.array([0, 0, 1.0])}
    for kind in ("euclidean", "minkowski(1)"):
        p = Distance.parse(kind).exponent
        unit = {k: v / (v**p).sum() ** (1 / p) for k, v in share.items()}
        got = {(r.row_label, r.col_label): r.distance for r in distances.spectral_distances(cells, labels, labels, Distance.parse(kind)).collect()}
        assert got == {(i, j): pytest.approx((np.abs(unit[i] - unit[j]) ** p).sum() ** (1 / p), abs=1e-7) for i in share for j in share}


#: fixed values: twelve points on a line
POINTS = [0.1, 0.1, 0.2, 0.2, 0.2, 0.7, 0.5, 0.99, 0.999, 0.05, 0.4, 0.05]


def test_band_pairs(frame):
    points = frame([*enumerate(POINTS), (12, None), (13, float("nan"))], "idx int, x double")
    got = sorted((r.lo, r.hi) for r in distances.band_pairs(points, 0.3).collect())
    assert got == [(i, j) for i in range(12) for j in range(i + 1, 12) if abs(POINTS[i] - POINTS[j]) <= 0.3] and len(got) == 33
    assert sorted((r.lo, r.hi) for r in distances.band_pairs(points, 0).collect()) == [(0, 1), (2, 3), (2, 4), (3, 4), (9, 11)]
    assert tuple(distances.coordinate_range(points.where("idx < 12")).first()) == (0.05, 0.999)


def test_embedding_distances(frame):
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(6, 3)), [0.5, 0.3, 0.2]
    df = frame([(str(i), row.tolist()) for i, row in enumerate(x)], VEC)
    plain = {(r.row_label, r.col_label): r.distance for r in distances.cross_distances(embeddings.embed(df, w, normalise=False), embeddings.embed(df, w, normalise=False), [1.0] * 3, normalise=False).collect()}
    weighted = {(r.row_label, r.col_label): r.distance for r in distances.cross_distances(df, df, w, normalise=False).collect()}
    assert plain == {k: pytest.approx(v) for k, v in weighted.items()}


def test_splits(frame):
    x = {"a": [0.0, 1.0], "b": [1.0, 1.0], "c": [5.0, 1.5], "d": [5.5, 9.0]}
    df = frame([(k, v) for k, v in x.items()], VEC)
    got = [tuple(r) for r in splits.gaps(df, 3).orderBy("split_id").collect()]
    assert got == [(1, 2, 7.5, 3), (2, 1, 4.0, 2), (3, 1, 1.0, 1)]
    members = {}
    for r in splits.split_members(df, splits.gaps(df, 2)).collect():
        members.setdefault(r.split_id, set()).add(r.label)
    assert members == {1: {"a", "b", "c"}, 2: {"a", "b"}}
    side, best = splits.bipartition(np.array([[0.0], [0.1], [10.0], [10.1]]), np.random.default_rng(0))
    assert side.any() and not side.all() and best > 0
    tree = splits.centroids(df, seed=1).collect()
    assert len(tree) == 2 * len(x) - 1  # a full binary tree; its leaves have weight 0
    for options in ({}, {"small": 1}, {"small": 2}):  # by one task, and level by level
        assert [tuple(r) for r in splits.centroids(df, seed=1, **options).orderBy("split_id").collect()] == sorted((tuple(r) for r in tree), key=lambda r: r[0])
    assert {r.split_id for r in splits.centroids(df, seed=1, depth=2).collect()} == {r.split_id for r in tree if len(r.split_id) <= 2}


def test_member_ranges(frame):
    import random

    from spectralmill.operators import splits

    random.seed(3)
    vectors = frame([(f"l{i:02d}", [random.random(), float(i % 5), random.gauss(0, 1)]) for i in range(30)], "label string, coords array<double>")
    for keep in (4, 10_000):
        found = splits.gaps(vectors, keep)
        ranges = splits.member_ranges(vectors, found).collect()
        expanded = sorted((s.split_id, r.label) for s in found.collect() for r in ranges if r.dim == s.dim and r.position <= s.position)
        assert expanded == sorted((r.split_id, r.label) for r in splits.split_members(vectors, found).collect())
        assert len(ranges) <= 30 * 3


def test_split_queries_take_all_labels(spark):
    """Every split of gaps_splits has its members, and centroid_splits splits all labels, not the class means."""
    from spectralmill.plans.queries import queries

    run = lambda name: queries()[name](spark, "/root/testdata/sf0.001")
    found, ranges = run("gaps_splits"), run("gaps_member_ranges")
    assert found.select("dim", "position").subtract(ranges.select("dim", "position")).isEmpty()
    labels = ranges.select("label").distinct().count()
    nodes = run("centroid_splits").select("split_id").count()
    assert nodes >= labels - 1 > 60


@pytest.mark.parametrize("n", [3, 41, 60, 301, 700])
def test_walk_equals_single_moves(n):
    """A walk in windows accepts what one move after the other would, with the same random numbers."""
    from spectralmill.operators import walks

    points = np.random.default_rng(n).normal(size=(n, 5)).round(3) * 2
    kept, best = walks.walk(points, np.random.default_rng(7), 0.2, 10.0)
    rng, moves = np.random.default_rng(7), 50 * max(n, 40)
    side = rng.random(n) < 0.5
    if side.all() or not side.any():
        side[rng.integers(n)] ^= True
    picks, least = rng.integers(n, size=moves), walks.least_gains(rng.random(moves), 0.2, 10.0)

    def objective(s):
        return np.abs(points[s].mean(0) - points[~s].mean(0)).sum() / np.sqrt(1 + abs(2 * s.sum() - n))

    now, rejected, top = objective(side), 0, (objective(side), side.copy())
    for pick, need in zip(picks, least, strict=True):
        if rejected == max(n, 40):
            break
        side[pick] ^= True
        then = objective(side) if side.any() and not side.all() else -np.inf
        if then - now >= need:
            now, rejected = then, 0
            top = (now, side.copy()) if now > top[0] + 1e-12 else top
        else:
            side[pick] ^= True
            rejected += 1
    assert best == pytest.approx(top[0])
    assert (kept == top[1]).all()


def test_walks_together_equal_walks_alone():
    from spectralmill.operators import walks

    rng = np.random.default_rng(1)
    counts, points = np.array([2, 3, 40, 7, 2, 101]), rng.normal(size=(155, 4)) * 2
    keys = rng.integers(1 << 63, size=6).astype(np.uint64)
    sides, best = walks.walk_together(points, counts, keys, 0.2, 10.0)
    at = 0
    for i, n in enumerate(counts):
        own, side = points[at : at + n], sides[at : at + n]
        alone, weight = walks.walk_together(own, counts[i : i + 1], keys[i : i + 1], 0.2, 10.0)
        assert (alone == side).all() and weight[0] == best[i] and side.any() and not side.all()
        assert best[i] == pytest.approx(np.abs(own[side].mean(0) - own[~side].mean(0)).sum() / np.sqrt(1 + abs(2 * side.sum() - n)))
        at += n


def test_centroids_of_more_than_200000_labels(spark):
    """A set of any size is split; once, more than 200,000 labels were refused."""
    from pyspark.sql import functions as F

    n = 200_001
    df = spark.range(n).select(F.col("id").cast("string").alias("label"), F.array((F.col("id") % 7).cast("double")).alias("coords"))
    (row,) = splits.centroids(df, seed=1, depth=1).collect()
    assert row.split_id == "0" and 0 < len(row.members) < n and row.weight > 0


def test_centroid_counts_of_more_than_200000_labels(spark, monkeypatch):
    """The counts of the first two levels; once, the splits behind them were refused."""
    from functools import partial
    from types import SimpleNamespace

    from pyspark.sql import functions as F

    from spectralmill.plans import queries

    vectors = spark.range(200_001).select(F.col("id").cast("string").alias("label"), F.array((F.col("id") % 7).cast("double")).alias("coords"))
    monkeypatch.setattr(splits, "centroids", partial(splits.centroids, depth=2))
    assert tuple(queries._centroid_counts(SimpleNamespace(vectors=lambda: vectors)).first()) == (3, 0, 2)
