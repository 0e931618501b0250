"""Round trips of files."""

import pytest

from strandlake.sources import fasta, metadata


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 first\nacgt\nNN-\n>s2\n\n>s3\nA\n")
    got = {r.sample_id: r.sequence for r in fasta.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {"s1": "ACGTNN-", "s2": "", "s3": "A"}
    fasta.write_fasta(spark.createDataFrame(list(got.items()), "sample_id string, sequence string"), str(tmp_path / "out"))
    assert {r.sample_id: r.sequence for r in fasta.read_fasta(spark, str(tmp_path / "out")).collect()} == got
    assert {r.sequence for r in fasta.read_fasta(spark, str(tmp_path / "a.fa"), "X").collect()} == {"XACGTNN-", "X", "XA"}


def test_metadata(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("Country\tRun\tIn_tree\tGenbank_N\nUK\tr1\tT\t5\nFR\tr2\tF\t.\n")
    got = metadata.read_metadata(spark, str(tmp_path / "m.tsv"), clean=True)
    assert [tuple(r) for r in got.orderBy("sample_id").collect()] == [("r1", "UK", True, 5), ("r2", "FR", False, -1)]
    (tmp_path / "bad.tsv").write_text("Run\tIn_tree\nr1\tmaybe\n")
    with pytest.raises(Exception, match="neither T nor F"):
        metadata.read_metadata(spark, str(tmp_path / "bad.tsv"), clean=True).collect()


def test_headers_with_marks_and_many_splits(spark, tmp_path):
    """A ">" inside a header starts no record; a file in many parts, with either kind of line break, reads the same."""
    one = tmp_path / "one.fa"
    one.write_bytes(b">s1 a>b note\nACGT\n>s2\r\nac\r\ngt\r\n>s3\n>s4 x >y\n\nNN")
    assert {(r.sample_id, r.sequence) for r in fasta.read_fasta(spark, str(one)).collect()} == {("s1", "ACGT"), ("s2", "ACGT"), ("s3", ""), ("s4", "NN")}
    want = {(f"x{i}", "ACGT>"[:4] * (i % 97)) for i in range(3000)}
    many = tmp_path / "many.fa"
    many.write_text("".join(f">{name} of > many\n{seq[:50]}\n{seq[50:]}\n" for name, seq in sorted(want)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1000", "4099", "20000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            found = fasta.read_fasta(spark, str(many))
            assert found.rdd.getNumPartitions() > 20 and found.count() == 3000 and {(r.sample_id, r.sequence) for r in found.collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
