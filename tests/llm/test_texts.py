import math
import random
import re

import pytest

from spectralmill.llm.leaks import PassageIndex, find_leaks
from spectralmill.llm.mixing import dual_sums, mix_sources, solve_rates, token_counts
from spectralmill.llm.truncation import ending, final_word, find_truncated, line_tokens, nodes_of, truncation_by_source, vocabulary_trie
from spectralmill.llm.words import words_of

DOCS = "doc_id bigint, text string, item_id string"
ITEMS = "item_id bigint, text string"


def runs(text, n):
    w = [x.lower() for x in re.findall("[A-Za-z0-9]+", text or "")]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_leaks_against_brute_force(frame):
    random.seed(9)
    words = ["sort", "the", "KKelvin", "list", "of", "Ünïcode", "x1", "RUN", "a"]
    text = lambda n: "".join(random.choice(words) + random.choice([" ", ", ", "\r\n", "_", "é"]) for _ in range(n))
    items = [(i, text(random.randint(0, 60))) for i in range(15)] + [(99, None), (100, "")]
    docs = [(i, text(random.randint(0, 200)), "z") for i in range(40)]
    for i in range(40, 80):
        source = items[i % 15][1]
        at = random.randint(0, max(0, len(source) - 200))
        docs.append((i, text(20) + " " + source[at:].upper() + " " + text(20), "z"))
    docs += [(200, None, ""), (201, "", ""), (202, text(3000) + " " + items[3][1] + " " + text(3000), "")]
    for n in (6, 20):
        want = {(d, i) for d, t, _ in docs for i, u in items if runs(t, n) & runs(u, n)}
        got = [tuple(r) for r in find_leaks(frame(docs, DOCS), frame(items, ITEMS), n).collect()]
        assert set(got) == want and len(got) == len(want)
    assert find_leaks(frame([], DOCS), frame(items, ITEMS)).count() == 0 and find_leaks(frame(docs, DOCS), frame([], ITEMS)).count() == 0


def test_shift_table_skips():
    index = PassageIndex([1], [" ".join(f"w{i}" for i in range(40))], 20)
    assert index.shift.max() == 15 and (index.shift == 0).sum() == 21


def test_hash_clashes_are_no_leaks(monkeypatch):
    """Passages whose words have equal hashes are told apart by their letters."""
    import numpy as np
    import pyarrow as pa

    from spectralmill.llm import words

    monkeypatch.setattr(words, "_VALUE", np.where(words._IS_WORD, np.uint64(1), np.uint64(0)))  # hashes tell only lengths
    index = PassageIndex([7], ["aa bb cc dd ee"], 3)
    text, item = index.search(pa.array(["xx yy zz xx", "q AA, BB cc", "cc dd ee", None]))
    assert list(text) == [1, 2] and list(item) == [0, 0]


def test_words(spark):
    import pyarrow as pa

    hashes, bounds = words_of(pa.array(["Ab c", None, "ab", "", "c" * 200_000, "d"]))
    assert list(bounds) == [0, 2, 2, 3, 3, 4, 5] and hashes[0] == hashes[2] and hashes[1] != hashes[3]


def test_mixing(frame):
    random.seed(2)
    sizes = [(i, s, random.randint(1, 400)) for i, s in enumerate(random.choices(["big", "mid", "rare"], [80, 15, 5], k=6000))] + [(9000, "big", 0), (9001, "other", 50)]
    docs = frame([(0, "x", "big")], "doc_id bigint, text string, source string")
    targets = frame([("big", 0.5, 1), (" MID ", 0.3, 3), ("rare", 0.1, 4), ("gone", 0.1, 4), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    copies, shares = mix_sources(docs, targets, sizes=frame(sizes, "doc_id bigint, source string, tokens bigint"))
    table = {r.source: r for r in shares.collect()}
    assert set(table) == {"big", "mid", "rare", "gone"} and table["gone"].actual_share == 0
    for s, share in (("big", 0.5), ("mid", 0.3), ("rare", 0.1)):
        assert table[s].actual_share == pytest.approx(share / 0.9, rel=0.01)
    rows = copies.collect()
    most = {"big": 1, "mid": 3, "rare": 4}
    assert all(0 <= r.copies <= most[r.source] for r in rows) and 9000 not in {r.doc_id for r in rows}
    # rates are tilted by size: of a source that is thinned out short documents are favoured, of one that is repeated long ones
    for s, repeated in (("big", False), ("rare", True)):
        used = sorted((r.tokens, r.rate) for r in rows if r.source == s)
        rates = [rate for _, rate in used]
        assert rates == sorted(rates, reverse=not repeated) and max(rates) - min(rates) > 0.05
        # every rate is exp(lambda * size), cut off at the cap
        free = [(t, math.log(rate)) for t, rate in used if 0.01 < rate < most[s] - 1e-6]
        assert len({round(x / t, 4) for t, x in free if t > 50}) <= 2
    assert {r.rate for r in rows if r.source == "mid"} == {3.0}  # the scarcest source is used up


def test_dual(frame):
    """The gradient of the dual is the gap in tokens: not 0 at the start, 0 at the solution; the solution is that of a plain search."""
    random.seed(3)
    sizes = [(s, random.randint(1, 3000), random.randint(1, 9)) for s in "abc" for _ in range(300)]
    table = frame(sizes, "source string, tokens bigint, documents bigint")
    have = {s: sum(t * d for x, t, d in sizes if x == s) for s in "abc"}
    docs = {s: sum(d for x, t, d in sizes if x == s) for s in "abc"}
    budget = {"a": (have["a"] * 0.07, have["a"] / docs["a"], 1), "b": (have["b"] * 2.9, have["b"] / docs["b"], 3), "c": (have["c"] * 1.4, have["c"] / docs["c"], 5)}
    gap = lambda state: {s: abs(g * budget[s][1] / budget[s][0] - 1) for s, (g, _) in dual_sums(table, state, budget).items()}
    assert min(gap(dict.fromkeys("abc", 0.0)).values()) > 0.1
    solved = solve_rates(table, budget)
    assert max(gap(solved).values()) < 1e-6
    for s, (wanted, mean, cap) in budget.items():
        low, high = -60.0, 60.0
        for _ in range(200):
            mid = (low + high) / 2
            tokens = sum(t * d * min(cap, math.exp(min(700, mid * t / mean))) for x, t, d in sizes if x == s)
            low, high = (mid, high) if tokens < wanted else (low, mid)
        assert solved[s] == pytest.approx(low, rel=1e-5)


def test_mixing_total_and_empty(frame):
    sizes = frame([(i, "a", 10) for i in range(50)] + [(100 + i, "b", 10) for i in range(5)], "doc_id bigint, source string, tokens bigint")
    docs = frame([], "doc_id bigint, text string, source string")
    targets = frame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    table = {r.source: r for r in mix_sources(docs, targets, total_tokens=600, sizes=sizes)[1].collect()}
    assert table["b"].copies == 10 and table["a"].tokens == pytest.approx(300, abs=20)
    assert mix_sources(docs, targets)[0].count() == 0


def test_tokens(frame):
    got = token_counts(frame([(1, "hello world", " A "), (2, None, None), (3, "", "b")], "doc_id bigint, text string, source string"))
    assert sorted((r.doc_id, r.source, r.tokens > 0) for r in got.collect()) == [(1, "a", True), (2, None, False), (3, "b", False)]


def test_trie(frame):
    nodes = vocabulary_trie(frame([("tight",), ("tiger",), ("a",)], "word string"), frame([("tig",), ("tigh",), ("tight",), ("x",)], "prefix string"))
    assert {r.prefix: r.words for r in nodes.collect()} == {"tig": 2, "tigh": 1}


def test_ends():
    assert final_word("return foldLate") == "late" and final_word("earl ...") is None and final_word("x = 1") is None and final_word("") is None
    assert line_tokens("  return foldLate(x_1, 12) the old Name") == ["return", "I", "(", "I", ",", "9", ")", "w", "W"]
    assert nodes_of(line_tokens("if a_b then"))[:2] == nodes_of(line_tokens("if c_d")) != nodes_of(line_tokens("while c_d"))
    assert ending("f(\n    if x_y {\n") == ending("f(\n    if x_y {") and ending("f(\n    if x_y {")[2] == 2
    assert ending("")[:2] == (None, 0)


def test_truncation(frame):
    random.seed(4)
    names = ["tally", "marker", "window", "folder", "ledger", "bucket"]

    def whole(n):
        return "".join(f"def {random.choice(names)}_{random.choice(names)}(x):\n    {random.choice(names)} = x + {random.randint(1, 99)}\n    return {random.choice(names)}\n\n" for _ in range(n))

    docs = [(i, whole(random.randint(2, 9)).rstrip("\n") + ("\n" if i % 4 else ""), "full") for i in range(400)]
    limited = [(1000 + i, whole(12)[:300], "short") for i in range(40)]
    broken = [(2000, whole(4) + "def marker_tally(x):\n    return buck", "full"), (2001, whole(4) + "def marker_tally(x):\n    wind�", "full")]
    copies = [(3000 + i, limited[i][1], "full") for i in range(3)]
    odd = [(4000, None, "full"), (4001, "", "full"), (4002, whole(3), None)]
    table = frame([(*r, "clash") for r in docs + limited + broken + copies + odd], "doc_id bigint, text string, source string, signs string")
    result = find_truncated(table)
    found = {r.doc_id for r in result.where("truncated").collect()}
    assert found >= {d for d, _, _ in limited + broken + copies}
    assert len(found - {d for d, _, _ in limited + broken + copies}) <= 2
    by = {r.source: r for r in truncation_by_source(result).collect()}
    assert by["short"].share == 1.0 and by[None].texts == 1
    assert find_truncated(table.limit(0)).count() == 0
    signs = {r.doc_id: r.signs for r in result.where("truncated").collect()}
    assert all("length" in signs[d] for d, _, _ in limited) and all("copy" in signs[d] for d, _, _ in copies) and "broken" in signs[2001]


def test_length_decides_between_equal_ends(frame):
    """Whole-looking ends at the limit of a source are cut, the same ends elsewhere are not."""
    random.seed(5)
    names = ["tally", "marker", "window", "folder", "ledger", "bucket"]
    line = lambda: f"{random.choice(names)}_{random.choice(names)} = {random.randint(1, 9)}\n"
    docs = [(i, "".join(line() for _ in range(random.randint(4, 60))), "free") for i in range(500)]
    docs += [(1000 + i, "x" * (1199 - len(t)) + "\n" + t, "capped") for i, t in enumerate("".join(line() for _ in range(30)) for _ in range(60))]
    docs = [(i, t[:1200], s) for i, t, s in docs]
    found = {r.doc_id for r in find_truncated(frame(docs, "doc_id bigint, text string, source string")).where("truncated").collect()}
    assert found == {i for i, t, s in docs if s == "capped"} and all(len(t) == 1200 for i, t, s in docs if s == "capped")



def test_copies_do_not_make_an_ending_usual(frame):
    """A cut text that is a third of all rows is found, and so are other cut texts of its form."""
    random.seed(7)
    names = ["tally", "marker", "window", "folder", "ledger", "bucket"]

    def whole(n):
        return "".join(f"def {random.choice(names)}_{random.choice(names)}(x):\n    {random.choice(names)} = x + {random.randint(1, 99)}\n    return {random.choice(names)}\n\n" for _ in range(n))

    docs = [(i, whole(random.randint(2, 9)), "full") for i in range(200)]
    cut = whole(3) + "def marker_tally(x):\n    window = ("
    copies = [(1000 + i, cut, "full") for i in range(100)] + [(2000, whole(2) + "def tally_marker(x):\n    bucket = (", "full")]
    found = {r.doc_id for r in find_truncated(frame(docs + copies, "doc_id bigint, text string, source string")).where("truncated").collect()}
    assert found == {d for d, _, _ in copies}
