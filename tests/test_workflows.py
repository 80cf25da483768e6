import pytest

from spectralmill.errors import DuplicateLabel, InvalidRegisterType
from spectralmill.operators import algebra, workflows
from spectralmill.operators.carry import carry_forward
from spectralmill.operators.order import place_rows
from spectralmill.operators.skew import join_margins
from spectralmill.plans.pipeline import CountDatabase, VectorDatabase
from spectralmill.streaming.incremental import latest_counts, start_counts, stream_counts

MATRIX = "row string, col string, value double"


def test_algebra(frame):
    a = frame([("r1", "k1", 1.0), ("r1", "k2", 2.0), ("r2", "k2", 3.0)], MATRIX)
    b = frame([("k1", "c", 4.0), ("k2", "c", 5.0)], MATRIX)
    assert sorted(map(tuple, algebra.multiply(a, b).collect())) == [("r1", "c", 14.0), ("r2", "c", 15.0)]
    assert sorted(map(tuple, algebra.multiply_vector(a, frame([("k2", 10.0)], "col string, value double")).collect())) == [("r1", 20.0), ("r2", 30.0)]
    assert sorted(map(tuple, algebra.transpose(a).collect()))[0] == ("k1", "r1", 1.0)
    v = frame([("x", [1.0])], "label string, coords array<double>")
    with pytest.raises(DuplicateLabel):
        algebra.merge_rows(v, v)


def test_order_and_carry(frame):
    rows = frame([(g, x) for g in ("a", "b", None) for x in range(30, 0, -3)], "g string, x int")
    got = sorted((r.g or "", r.x, r.position) for r in place_rows(rows, ["g"], ["x"]).collect())
    assert got == sorted((g, x, i + 1) for g in ("a", "b", "") for i, x in enumerate(sorted(range(30, 0, -3))))
    lines = frame([("f", i, "h%d" % i if i in (3, 17) else None) for i in range(40)], "g string, n int, h string")
    filled = {r.n: r.last for r in carry_forward(lines, "g", "n", lines.h, "last", chunk=5).collect()}
    assert filled == {i: None if i < 3 else "h3" if i < 17 else "h17" for i in range(40)}


def test_hot_join(frame):
    rows = frame([("hot", i) for i in range(500)] + [(f"c{i}", i) for i in range(20)] + [(None, 1)], "k string, v int")
    margins = rows.where("k is not null").groupBy("k").count()
    for small in (8 << 20, 0):  # margins broadcast whole, and only those of hot keys
        got = join_margins(rows, margins, "k", "count", small_bytes=small)
        assert got.count() == 520 and got.where("k = 'hot' and count = 500").count() == 500
        left = join_margins(rows, margins.where("k <> 'c1'"), "k", "count", "left", small_bytes=small)
        assert left.count() == 521 and {(r.k, r["count"]) for r in left.where("k is null or k = 'c1'").collect()} == {(None, None), ("c1", None)}
    assert join_margins(rows, margins.limit(0), "k", "count").count() == 0


def test_glue(frame):
    meta = frame([(f"s{i}", "A" if i % 3 else "B.1") for i in range(9)], "label string, class_name string")
    parts = {r.label: r.part for r in workflows.train_test_split(meta, "class_name").collect()}
    assert [parts[f"s{i}"] for i in (0, 3, 6)] == ["train", "test", "train"]
    truth = frame([("s0", "B"), ("s1", "A"), ("s2", "C")], "label string, true_class string")
    got = workflows.accuracy(frame([("s0", "B.1"), ("s1", "A"), ("s2", "A")], "label string, predicted string"), truth).first()
    assert tuple(got) == (3, 2, 1)
    spectra = frame([(2, "a", "x", 4), (2, "a", "y", 1), (3, "a", "x", 2), (3, "a", "y", 2)], "k int, label string, kmer string, count bigint")
    assert workflows.best_k(workflows.choose_k(spectra)).first().k == 2
    reads = frame([("r", "AAAACCCC"), ("q", "AAAAGG"), ("z", None)], "tag string, seq string")
    assert [r.tag for r in workflows.filter_reads(reads, frame([("AAAA",), ("CCCC",)], "segment string"), 4, 2).collect()] == ["r"]


def test_random_forest(frame):
    rows = [(f"{c}{i}", [float(i % 5), 10.0 * (c == "a")], c) for c in "ab" for i in range(20)]
    df = frame(rows, "label string, coords array<double>, class_name string")
    got = workflows.random_forest(df.select("label", "coords"), df.select("label", "coords"), df.select("label", "class_name"), trees=5)
    assert all(r.label[0] == r.predicted for r in got.collect())


def test_pipelines(spark, frame, tmp_path):
    (tmp_path / "s.txt").write_text("\ta\nAC\t4\nGT\t1\n\tb\nAC\t1\nTT\t6\n\tc\nGT\t5\n")
    (tmp_path / "m.tsv").write_text("label\tkind\na\tx\nb\ty\nc\tx\n")
    db = CountDatabase(spark).add_spectra(str(tmp_path / "s.txt")).add_metadata(str(tmp_path / "m.tsv"))
    assert tuple(db.summary().first()) == (3, 3, "kind")
    db.select_matching([("kind", "x")]).add_combined_selected("X")
    assert db.cells.where("label = 'X'").count() == 2 and db.metadata.where("label = 'X'").first().kind == "x"
    db.select_labels(["a"]).selection_to_filter()
    assert "a" not in {r.label for r in db.exported().collect()}
    db.negate_selection().remove_selected()
    assert {r.label for r in db.cells.collect()} == {"a"}
    db.save(str(tmp_path / "db"))
    assert CountDatabase(spark).load(str(tmp_path / "db")).cells.count() == 2
    full = CountDatabase(spark).add_spectra(str(tmp_path / "s.txt"))
    vec = VectorDatabase(spark).fitted(full.fit())
    vec.twisted = None
    vec.add_spectra(full.cells).set(metric="flat", distance="euclidean", keep=1).embed().split()
    assert vec.vectors.count() == 3 and vec.splits.count() == 2 * vec.dims()
    assert vec.distances_from(vec.twisted).summary().count() == 3
    with pytest.raises(InvalidRegisterType):
        vec.load("colour", "x")


def test_stream(spark, tmp_path):
    schema = "label string, kmer string, count bigint, batch int, loaded_at timestamp"
    rows = [("a", "AAAC", 2, 1, "2022-01-01 00:00:00"), ('"a"', "gttt", 2, 1, "2022-01-01 00:01:00"), ("a", "AAAC", 5, 2, "2022-01-01 00:02:00"), (None, "AAAC", 5, 2, "2022-01-01 00:02:00")]
    spark.createDataFrame(rows, schema.replace("timestamp", "string")).selectExpr("label", "kmer", "count", "batch", "cast(loaded_at as timestamp) loaded_at").write.parquet(str(tmp_path / "in"))
    counts = stream_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    start_counts(counts, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert [tuple(r) for r in latest_counts(spark.read.parquet(str(tmp_path / "out"))).collect()] == [("a", "AAAC", 7)]
