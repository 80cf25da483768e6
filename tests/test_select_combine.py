import pytest

from spectralmill.errors import ClassesLabelNotFound, ClassLabelIsAlsoSpectrumName, EmptySelection, InvalidNumberOfClasses, UnknownCombinationCriterion
from spectralmill.operators import combine, select
from spectralmill.operators.distill import COLUMNS, distill

CELLS = "label string, kmer string, count bigint"
ROWS = [("s1", "a", 3), ("s1", "b", 1), ("s2", "a", 4), ("s2", "c", 4), ("s3", "a", 10), ("t1", "c", 2)]
META = [("s1", "x", "p"), ("s2", "x", "q"), ("s3", "x", "p"), ("t1", "y", "p"), ("u", "y", "")]


@pytest.fixture
def cells(frame):
    return frame(ROWS, CELLS)


@pytest.fixture
def meta(frame):
    return frame(META, "label string, kind string, place string")


def names(df):
    return sorted(r.label for r in df.collect())


def test_selection(cells, meta):
    labels = select.all_labels(cells, meta)
    assert names(labels) == ["s1", "s2", "s3", "t1", "u"]
    assert names(select.select_labels(labels, ["s1", "nothing"])) == ["s1"]
    assert names(select.select_matching(labels, [("", "s\\|t"), ("place", "p")], meta)) == ["s1", "s3", "t1"]
    assert names(select.select_matching(labels, [("", "1")], meta)) == []  # anchored
    assert names(select.select_matching(labels, [("nofield", "p")], meta)) == []
    chosen = select.select_matching(labels, [("", "s")])
    assert names(select.negate_selection(labels, chosen)) == ["t1", "u"]
    assert names(select.remove_selected(cells, chosen)) == ["t1"]
    assert names(select.keep_selected(meta, chosen)) == ["s1", "s2", "s3"]


@pytest.mark.parametrize("pattern, text, fits", [("a\\(b\\|c\\)d", "acd", True), ("a(b)", "a(b)x", True), ("a|b", "b", False), ("[]x]", "]", True), ("x{2}", "x{2}", True)])
def test_pattern_syntax(frame, pattern, text, fits):
    assert (select.select_matching(frame([(text,)], "label string"), [("", pattern)]).count() == 1) is fits


def test_combine(cells, frame):
    groups = frame([("s1", "g"), ("s2", "g"), ("s3", "g"), ("t1", "h"), ("zz", "h"), ("s1", None)], "label string, `group` string")
    mean = {(r.label, r.kmer): r["count"] for r in combine.combine_by_group(cells, groups).collect()}
    # norms 4, 8, 10: a = 3*10/4 + 4*10/8 + 10
    assert mean == {("g", "a"): 22, ("g", "b"): 2, ("g", "c"): 5, ("h", "c"): 2}
    median = {(r.label, r.kmer): r["count"] for r in combine.combine_by_group(cells, groups, "median").collect()}
    assert median == {("g", "a"): 22, ("h", "c"): 4}  # upper median 7.5 of (5, 7.5, 10) times 3; zz has no counts but is found
    with pytest.raises(UnknownCombinationCriterion):
        combine.combine_by_group(cells, groups, "mode")


def test_combine_selected_and_classes(cells, meta, frame):
    got = combine.combine_selected(cells, select.select_labels(cells, ["s1", "s2"]), "s3")
    assert {(r.kmer, r["count"]) for r in got.where("label = 's3'").collect()} == {("a", 10), ("b", 2), ("c", 4)}
    with pytest.raises(EmptySelection):
        combine.combine_selected(cells, select.select_labels(cells, ["none"]), "z")
    spectra, fields = combine.combine_classes(cells, meta, "kind")
    assert names(spectra.select("label").distinct()) == ["x", "y"]
    assert {r.label: (r.kind, r.place) for r in fields.collect()} == {"x": ("x", ""), "y": ("y", "")}
    assert {r.label: r.indicator for r in combine.class_indicator(meta, "kind").collect()} == {"s1": 0, "s2": 0, "s3": 0, "t1": 1, "u": 1}
    with pytest.raises(ClassesLabelNotFound):
        combine.class_groups(meta, "colour")
    with pytest.raises(ClassLabelIsAlsoSpectrumName):
        combine.combine_classes(cells, frame([("s1", "s2")], "label string, kind string"), "kind")


def test_distill_against_dense(frame):
    import itertools
    import random

    random.seed(3)
    kmers, spectra = [f"k{i}" for i in range(6)], {f"s{i}": f"c{i % 3}" for i in range(7)}
    counts = {(s, k): random.choice([0, 0, 1, 3, 9]) for s in spectra for k in kmers}
    for s in spectra:
        counts[(s, "k0")] += 1
    cells = frame([(s, k, n) for (s, k), n in counts.items() if n], CELLS)
    table = {r.kmer: r for r in distill(cells, frame(list(spectra.items()), "label string, `group` string")).collect()}
    sums = {s: sum(counts[(s, k)] for k in kmers) for s in spectra}
    for k in table:
        buckets = {}
        for a, b in itertools.combinations(sorted(spectra), 2):
            d = abs(counts[(a, k)] / sums[a] - counts[(b, k)] / sums[b])
            buckets.setdefault(tuple(sorted((spectra[a], spectra[b]))), []).append(d)
        means = {key: sum(v) / len(v) for key, v in buckets.items()}
        inner, outer = sorted(v for (a, b), v in means.items() if a == b), sorted(v for (a, b), v in means.items() if a != b)
        assert table[k].InnerAvgMean == pytest.approx(sum(inner) / len(inner)) and table[k].OuterAvgMean == pytest.approx(sum(outer) / len(outer))
        assert table[k].InnerAvgMedian == pytest.approx(inner[len(inner) // 2]) and table[k].OuterAvgMedian == pytest.approx(outer[len(outer) // 2])
        var = {key: sum((x - means[key]) ** 2 for x in v) / (len(v) - 1) if len(v) > 1 else 0 for key, v in buckets.items()}
        assert table[k].OuterVarMean == pytest.approx(sum(v for (a, b), v in var.items() if a != b) / 3)
    assert table["k0"].asDict().keys() == {"kmer", *COLUMNS}
    with pytest.raises(InvalidNumberOfClasses):
        distill(cells, frame([(s, "one") for s in spectra], "label string, `group` string"))


def test_distill_forms_no_pairs(frame, spark):
    """A k-mer of all spectra is summed without its pairs, and agrees with them; so are k-mers that are cut into chunks."""
    import random

    import numpy as np

    from spectralmill.operators.distill import _gap_sums, _moments

    random.seed(5)
    group = np.array([i % 5 for i in range(300)] + [5] * 7 + [6] * 3)
    x = np.array([random.choice([0.1, 0.1, random.random()]) for _ in range(300)] + [0.3] * 10)
    held, base, whole, _, _ = _moments(group, x, 7)
    s1 = _gap_sums(group, x, base, held, whole, (np.zeros(7), np.zeros(7)), 7)
    for a in range(7):
        for b in range(7):
            assert s1[a, b] == pytest.approx(np.abs(x[group == a][:, None] - x[group == b][None]).sum())
    assert s1[5, 5] == s1[6, 6] == s1[5, 6] == 0
    cells = [(f"s{i}", f"k{k}", random.randint(1, 9)) for i in range(60) for k in range(4) if random.random() < (1, 0.9, 0.5, 0.1)[k]]
    groups = frame([(f"s{i}", f"c{i % 4}") for i in range(60)], "label string, `group` string")
    plain, chunked = ({r.kmer: tuple(r)[1:] for r in distill(frame(cells, CELLS), groups, chunk=c).collect()} for c in (1 << 20, 10))
    assert plain == {k: pytest.approx(v, abs=1e-12) for k, v in chunked.items()} and len(plain) == 4
    # six classes of 6,000 spectra that all hold two k-mers: 36 million pairs
    cells = spark.range(12_000).selectExpr("concat('s', id div 2) as label", "concat('k', id % 2) as kmer", "1 + id % 7 as count")
    groups = spark.range(6_000).selectExpr("concat('s', id) as label", "concat('c', id % 6) as `group`")
    assert distill(cells, groups).count() == 2
