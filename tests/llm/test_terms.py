import itertools
import random

import pytest

from spectralmill.llm.distinctive import distinctive_terms
from spectralmill.llm.term_counts import mark_terms, ngram_counts, suffixes_of

RECORDS = "record string, terms array<string>, suffix int"


def brute(records, length):
    out = {}
    for name, terms in records:
        terms = [t for t in terms or [] if t is not None]
        for i, n in itertools.product(range(len(terms)), range(1, length + 1)):
            if i + n <= len(terms):
                c = out.setdefault(tuple(terms[i : i + n]), [0, set()])
                c[0] += 1
                c[1].add(name)
    return {k: (c, len(r)) for k, (c, r) in out.items()}


@pytest.mark.parametrize("length", [1, 3])
def test_ngrams(frame, length):
    random.seed(length)
    records = [(f"r{i % 40}", [random.choice("abcdé") if random.random() < 0.7 else "a" for _ in range(random.randint(0, 30))]) for i in range(60)]
    records += [("n", None), ("e", []), ("z", ["a", None, "b"]), ("r1", ["a"] * 400)]
    got = ngram_counts(suffixes_of(frame([(n, t, 1) for n, t in records], RECORDS), "record", "terms", length), length)
    assert {tuple(r.ngram): (r["count"], r.records) for r in got.collect()} == brute(records, length)
    split = ngram_counts(suffixes_of(frame([(n, t, 1) for n, t in records], RECORDS), "record", "terms", length), length, part=20)
    assert {tuple(r.ngram): (r["count"], r.records) for r in split.collect()} == brute(records, length)


def test_ngrams_empty(frame):
    assert ngram_counts(frame([], "record string, suffix array<string>, weight bigint"), 2).count() == 0


def test_marks(frame):
    counts = frame([("a", 5, 2), ("b", 5, 3), ("c", 6, 3), ("d", 70, 7), ("e", 70, 6)], "t string, count bigint, records bigint")
    assert {r.t: r.mark for r in mark_terms(counts, 10).collect()} == {"a": "rare", "b": "rare", "c": "useful", "d": "common", "e": "useful"}


def test_residuals(frame):
    rows = [("x", "t", 4), ("x", "u", 6), ("y", "t", 5), ("y", "v", 5), (None, "t", 9), ("z", None, 9), ("z", "t", 0), ("z", "t", None)]
    got = {(r.record, r.term): r for r in distinctive_terms(frame([(*r, "clash") for r in rows], "a string, b string, c bigint, record_total string"), "a", "b", "c").collect()}
    assert set(got) == {("x", "t"), ("x", "u"), ("y", "t"), ("y", "v")}
    r = got[("x", "u")]
    assert (r.record_total, r.term_total, r.holders, r.records, r.grand_total) == (10, 6, 1, 2, 20)
    assert r.expected == 3 and r.residual == pytest.approx(3 / 3**0.5) and r.adjusted_residual == pytest.approx(3 / 3**0.5 / (0.5 * 0.7) ** 0.5)
    single = distinctive_terms(frame([("x", "t", 4)], "record string, term string, weight bigint")).first()
    assert single.residual == 0 and single.adjusted_residual is None
    assert distinctive_terms(frame([], "record string, term string, weight bigint")).count() == 0
