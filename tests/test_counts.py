"""Cleaning, k-mers, accumulated counts, statistics and transformations on toy tables."""

import math

import pytest

from spectralmill.errors import InvalidContent, InvalidTransformation, UnknownTransformation
from spectralmill.functions.cleaning import clean_kmer, clean_label
from spectralmill.functions.kmers import hash_hex
from spectralmill.operators.counts import accumulate_spectra
from spectralmill.operators.sequences import count_kmers
from spectralmill.operators.stats import count_statistics
from spectralmill.operators.transforms import Transformation, transform_counts, zero_values

SPECTRA = "label string, kmer string, count bigint, batch int, _hot string"
CELLS = "label string, kmer string, count bigint"
TOY = [("a", "k1", 5), ("a", "k2", 2), ("a", "k3", 1), ("b", "k1", 10), ("c", "k3", 4)]


def test_cleaning(frame):
    rows = frame([(' "x" ', " ttta "), ("  y", "ACGT"), ('"', None), (None, "AC"), ("", "")], "label string, kmer string")
    got = [tuple(r) for r in rows.select(clean_label(rows.label), clean_kmer(rows.kmer)).collect()]
    assert got == [("x", "TAAA"), ("y", "ACGT"), ('"', None), (None, "AC"), ("", "")]


def test_accumulate(frame):
    rows = [("x", "AAAC", 2, 1, "q"), ('"x"', "gttt", 2, 1, "r"), ("x", "AAAC", 2, 2, "q"), ("x", "AAAC", 3, 1, None), (None, "AAAC", 1, 1, ""), ("x", None, 1, 1, ""), ("x", "AAAC", None, 1, ""), ("x", "AAAC", 0, 1, ""), ("x", "AAAC", -4, 1, "")]
    assert [tuple(r) for r in accumulate_spectra(frame(rows, SPECTRA)).collect()] == [("x", "AAAC", 7)]
    assert accumulate_spectra(frame([], SPECTRA)).count() == 0


def brute_kmers(seq, k, ds):
    out = {}
    for i in range(len(seq) - k + 1):
        w = seq[i : i + k].upper()
        if set(w) <= set("ACGT"):
            w = min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA"))) if ds else w
            out[w] = out.get(w, 0) + 1
    return out


@pytest.mark.parametrize("ds", [True, False])
def test_kmers(frame, ds):
    seqs = ["AACGT", "acgtt", "ACGT", "ACNGTACG", "AC", "", None, "ACGTTGCA" * 20_000, "aßcgtta"]
    got = count_kmers(frame([(str(i), s) for i, s in enumerate(seqs)], "tag string, seq string"), 3, "DNA-ds" if ds else "DNA-ss")
    table = {}
    for r in got.collect():
        table.setdefault(int(r.label), {})[r.kmer] = r["count"]
    assert table == {i: want for i, s in enumerate(seqs) if (want := brute_kmers(s or "", 3, ds))}


def test_kmer_limits_and_hex(frame):
    rows = frame([("A" * 30,), ("T" * 30,), ("ACGT",)], "k string")
    assert [r[0] for r in rows.select(hash_hex(rows.k)).collect()] == ["0", f"{4**30 - 1:x}", "1b"]
    with pytest.raises(InvalidContent):
        count_kmers(frame([], "tag string, seq string"), 31)
    with pytest.raises(InvalidContent):
        count_kmers(frame([], "tag string, seq string"), 3, "RNA")


def test_statistics(frame):
    got = {r.label: tuple(r)[1:] for r in count_statistics(frame(TOY, CELLS), "label", 2, 1).collect()}
    assert got["a"][:4] == (2, 0, 5, 7.0) and got["a"][4] == pytest.approx(math.log(10))
    assert got["c"][:4] == (1, 0, 4, 4.0)
    relative = {r.label: r.non_zero for r in count_statistics(frame(TOY, CELLS), "label", 0.2, 1).collect()}
    assert relative == {"a": 2, "b": 1, "c": 1}
    assert {r.kmer: r.max for r in count_statistics(frame(TOY, CELLS), "kmer", 3, 1).collect()} == {"k1": 10, "k2": 0, "k3": 4}


def test_transformations(frame):
    cells = frame(TOY, CELLS)
    value = lambda *t: {(r.label, r.kmer): r.value for r in transform_counts(cells, Transformation(*t)).collect()}
    assert value("binary", 2, 1)[("a", "k3")] == 0.0 and value("binary", 2, 1)[("a", "k2")] == 1.0
    assert value("pow", 2, 0.5)[("a", "k1")] == pytest.approx(5**0.5)
    center = (math.log(5) + math.log(2)) / 3
    assert value("CLR", 1, 1)[("a", "k1")] == pytest.approx(math.log(5) - center)
    assert {r.label: r.value for r in zero_values(cells, Transformation("clr", 1, 1)).collect()}["a"] == pytest.approx(math.log(0.1) - center)
    assert value("pseudo", 1, 0)[("a", "k2")] == pytest.approx(math.floor(5 * math.log(3)) / 3)  # the sum is one of counts to the power 0
    assert value("pseudo", 2, 2)[("a", "k1")] == pytest.approx(math.floor((25 - 1) / (4 - 1)) / 29)
    # a relative threshold is first a part of all counts (5 alone passes 2.4), then the same part of those that passed (1.5)
    assert value("power", 0.3, 1)[("a", "k2")] == 2.0 and value("power", 0.3, 1)[("a", "k3")] == 0.0
    with pytest.raises(UnknownTransformation):
        Transformation("log")
    with pytest.raises(InvalidTransformation):
        Transformation("pseudo", 1, -1)


def test_texts_without_language_are_counted(spark):
    """The spectrum of all texts holds those of tagged and untagged ones, which have a spectrum of label null."""
    from pyspark.sql import functions as F

    from spectralmill.plans.queries import Tables, queries

    where = "/root/testdata/sf0.001"
    assert not Tables(spark, where).sequences().where("tag is null").isEmpty()
    total = lambda frame: frame.agg(F.sum("count")).first()[0]
    by_tag = queries()["kmer_count_dna_ds"](spark, where)
    assert total(by_tag) == total(count_kmers(Tables(spark, where).sequences(), 5, "DNA-ds", label="all")) and not by_tag.where("label is null").isEmpty()
