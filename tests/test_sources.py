import pytest

from spectralmill.errors import DuplicateField, IncompatibleArchiveVersion, MixedInputs, UnexpectedType
from spectralmill.sources import sequences, tables
from spectralmill.sources.spectra_lines import load_lines, rejected_lines

CELLS = "label string, kmer string, count bigint"


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 first\nACG\nT>A\n>s2\r\nGG\r\nCC\r\n>s3\n")
    got = [tuple(r) for r in sequences.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("tag").collect()]
    assert got == [("s1", 0, "ACGT>A"), ("s2", 0, "GGCC"), ("s3", 0, "")]
    (tmp_path / "r.fq").write_text("@r1 x\nACGT\n+\n@@II\n@r2\n\n+\n\n@r3\nGG\n+r3\n>I\n")
    got = [tuple(r) for r in sequences.read_fastq(spark, str(tmp_path / "r.fq")).collect()]
    assert ("r1", 0, "ACGT") in got
    both = sequences.read_sequences(spark, paired=[(str(tmp_path / "r.fq"), str(tmp_path / "r.fq"))])
    assert {r.segm for r in both.collect()} == {0, 1}
    with pytest.raises(MixedInputs):
        sequences.read_sequences(spark, fasta=["a"], single=["b"])


def test_spectra_round_trip(spark, frame, tmp_path):
    cells = frame([("a", "AC", 3), ("a", "GT", 1), ("b", "AC", 2)], CELLS)
    tables.write_spectra(cells, str(tmp_path / "out"))
    assert sorted(tables.read_spectra(spark, str(tmp_path / "out")).collect()) == sorted(cells.collect())
    (tmp_path / "x.txt").write_text('\t"a"\nAC\t1\n\tb\nAC\t2\n\ta\nAC\t5\n')
    assert sorted(map(tuple, tables.read_spectra(spark, str(tmp_path / "x.txt")).collect())) == [("a", "AC", 6), ("b", "AC", 2)]
    (tmp_path / "bad.txt").write_text("AC\t1\n\tb\nAC\t2\n")
    with pytest.raises(Exception, match="header expected"):
        tables.read_spectra(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "worse.txt").write_text("\tb\nAC\tx\n")
    with pytest.raises(Exception, match="wrong format"):
        tables.read_spectra(spark, str(tmp_path / "worse.txt")).collect()


def test_metadata(spark, tmp_path):
    (tmp_path / "m.tsv").write_text('name\tkind\tplace\n"a"\tx\t\nb\ty\tq\n')
    old = tables.read_metadata(spark, str(tmp_path / "m.tsv"))
    (tmp_path / "n.tsv").write_text("name\tplace\tnew\nb\tz\t1\nc\tw\t2\n")
    both = tables.add_metadata(old, tables.read_metadata(spark, str(tmp_path / "n.tsv")))
    assert sorted(map(tuple, both.collect())) == [("a", "x", "", ""), ("b", "y", "z", "1"), ("c", "", "w", "2")]
    (tmp_path / "d.tsv").write_text("name\tk\tk\na\t1\t2\n")
    with pytest.raises(DuplicateField):
        tables.read_metadata(spark, str(tmp_path / "d.tsv"))
    (tmp_path / "w.tsv").write_text("name\tk\na\t1\t2\n")
    with pytest.raises(Exception):
        tables.read_metadata(spark, str(tmp_path / "w.tsv")).collect()


def test_matrix_and_archives(spark, frame, tmp_path):
    vectors = frame([("a b", [1.5, -2.0]), ("c", [0.1, 3e10])], "label string, coords array<double>")
    tables.write_matrix(vectors, str(tmp_path / "m"), ["Dim1", "Dim2"])
    parts = sorted((tmp_path / "m").glob("part-*"))
    assert parts[0].read_text().splitlines()[0] == '""\t"Dim1"\t"Dim2"'
    assert sorted(map(tuple, tables.read_matrix(spark, str(tmp_path / "m")).collect())) == sorted(map(tuple, vectors.collect()))
    tables.write_archive({"twisted": vectors}, "twisted", str(tmp_path / "t"))
    assert tables.read_archive(spark, str(tmp_path / "t"), "twisted")["twisted"].count() == 2
    with pytest.raises(UnexpectedType):
        tables.read_archive(spark, str(tmp_path / "t"), "vectors")
    version, tables.VERSION = tables.VERSION, "2"
    try:
        with pytest.raises(IncompatibleArchiveVersion):
            tables.read_archive(spark, str(tmp_path / "t"), "twisted")
    finally:
        tables.VERSION = version


LINES = [
    ("f", 1, "\ts1"), ("f", 2, "ACGTACGTACGT\t5\r"), ("f", 3, '"acgtacgtacgt"\t"1.5e1"'), ("f", 4, None), ("f", 5, "A\tB\tC"), ("f", 6, 'ACGTACGTACGT\t"5'), ("f", 7, "ACGT\t5"),
    ("f", 8, "ACGTACGTACGT\t-5"), ("f", 9, "ACGTACGTACGT\t2147483648"), ("f", 10, "\t"), ("f", 11, "ACGTACGTACGT\t7"), ("f", 12, '\ts"2'), ("f", 13, "ACGTACGTACGT\t8"), ("f", 14, "ACGTACGTACGT\t5\r\r"),
    ("g", 1, "ACGTACGTACGT\t3"), ("g", 2, "ACGTACGTACGT\t1e999"), ("g", 3, ""), ("g", 4, "ACGTACGTACGT\t"), ("g", 5, "ACGTACGTACGT\t９"), ("g", 6, '""\ts3'), ("g", 7, "ACGTACGTACGT\t0.5"),
]


def test_lines_that_fail(frame):
    lines = frame([(i, f, n, x, "clash") for i, (f, n, x) in enumerate(LINES)], "line_id bigint, file_name string, line_no int, line string, value string")
    got = {r.line_id: r.reason for r in rejected_lines(lines).collect()}
    want = {3: "columns", 4: "columns", 5: "quoting", 6: "name", 7: "value", 8: "value", 9: "value", 11: "quoting", 13: "value", 14: "header", 15: "value", 16: "columns", 17: "value", 18: "value"}
    assert got == want
    loaded = sorted((r.file_name, r.line_no, r.label, r.v) for r in load_lines(lines).collect())
    assert loaded == [("f", 2, "s1", 5.0), ("f", 3, "s1", 15.0), ("f", 11, None, 7.0), ("f", 13, None, 8.0), ("g", 7, "s3", 0.5)]
    assert rejected_lines(lines.limit(0)).count() == 0 and load_lines(lines.limit(0)).count() == 0
