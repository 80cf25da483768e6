import numpy as np
import pytest

from spectralmill.errors import DuplicateLabel, InsufficientElements
from spectralmill.operators import fit, workflows
from spectralmill.operators.distances import summarise_rowwise
from spectralmill.operators.embeddings import metric_vector
from spectralmill.operators.project import project
from spectralmill.operators.sequences import count_kmers

VALUES = "label string, kmer string, value double"


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(4)
    return rng.poisson(2.0, (12, 5)) * rng.integers(0, 2, (12, 5)) + np.eye(12, 5)


def long(frame, x):
    return frame([(f"s{j}", f"k{i:02d}", float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1]) if x[i, j]], VALUES)


def test_fit_against_dense(frame, table):
    model = fit.fit_twister(long(frame, table))
    share = table / table.sum(0)
    p = share / share.sum()
    r, c = p.sum(1), p.sum(0)
    keep = r > 0
    s = (p - np.outer(r, c))[keep] / np.sqrt(np.outer(r, c))[keep]
    sv = np.linalg.svd(s, compute_uv=False)[:4]
    inertia = [row.value for row in model.inertia.orderBy("dim").collect()]
    assert inertia == pytest.approx(sv**2 / (sv**2).sum()) and sum(inertia) == pytest.approx(1)
    # projecting the training spectra gives the coordinates of the fit
    twisted = {row.label: row.coords for row in model.twisted.collect()}
    again = {row.label: row.coords for row in project(long(frame, table), model.twister, 4).collect()}
    assert again == {k: pytest.approx(v) for k, v in twisted.items()}
    with pytest.raises(DuplicateLabel):
        project(long(frame, table), model.twister, 4, into=model.twisted)


def test_kmer_filters(frame, table):
    values = long(frame, table)
    sums = table.sum(1)
    kept = {r.kmer for r in fit.threshold_kmers(values, 0.5).select("kmer").distinct().collect()}
    assert kept == {f"k{i:02d}" for i in range(12) if sums[i] >= 0.5 * sums.max()}
    assert fit.sample_kmers(values, 0.5, 1).select("kmer").distinct().count() == int((sums > 0).sum() * 0.5)
    assert fit.keep_kmers(values, frame([("k00",), ("zz",)], "kmer string")).select("kmer").distinct().count() == 1
    with pytest.raises(InsufficientElements):
        fit.fit_twister(values.where("label = 's0'"))


def test_classifier(frame):
    """Classes of mutated copies of random roots: fitted on half, all of the rest is told apart."""
    rng = np.random.default_rng(7)
    train, test = [], []
    for c in range(5):
        root = rng.choice(list("ACGT"), 400)
        for i in range(12):
            copy = root.copy()
            at = rng.random(400) < 0.01
            copy[at] = rng.choice(list("ACGT"), at.sum())
            (train if i % 2 else test).append((f"C{c}" if i % 2 else f"S{i}-C{c}", "".join(copy)))
    spectra = lambda rows: count_kmers(frame(rows, "tag string, seq string"), 5)
    model = fit.fit_twister(spectra(train).withColumnRenamed("count", "value"))
    dims = model.inertia.count()
    near = summarise_rowwise(project(spectra(test), model.twister, dims), model.twisted, metric_vector(model.inertia))
    truth = frame([(name, name.split("-")[1]) for name, _ in test], "label string, true_class string")
    got = workflows.accuracy(workflows.nearest_class(near), truth).first()
    assert (got["items"], got["wrong"]) == (30, 0)
