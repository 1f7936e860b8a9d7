"""Readers of matrices and annotation."""

import pytest

from dispersa.operators import sequences
from dispersa.sources import annotation, matrices


def test_wide_csv(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text('"","u.1","u.2"\ng1,0,3\ng2,5,0\n')
    got = sorted(tuple(r) for r in matrices.read_wide_csv(spark, str(p), "d").collect())
    assert got == [("d", "g1", "u.2", 3), ("d", "g2", "u.1", 5)]


@pytest.mark.parametrize("head", ["id\tu1\tu2", "u1\tu2"])
def test_matrix_headers(spark, tmp_path, head):
    p = tmp_path / "m.tsv"
    p.write_text(f"{head}\ng1\t1\t2\ng2\t0\t4\n")
    assert sorted(tuple(r) for r in matrices.read_matrix(spark, str(p)).collect()) == [("g1", "u1", 1.0), ("g1", "u2", 2.0), ("g2", "u2", 4.0)]
    assert sorted(tuple(r) for r in matrices.read_matrix(spark, str(p), keep=["u2"]).collect()) == [("g1", "u2", 2.0), ("g2", "u2", 4.0)]


def test_numeric_columns(spark):
    df = spark.createDataFrame([("a", "1", "x", ""), ("b", " ", "2", "3.5")], "k string, p string, q string, r string")
    got, dropped = matrices.numeric_columns(df, "k")
    assert dropped == ["q"] and [tuple(r) for r in got.orderBy("k").collect()] == [("a", 1.0, None), ("b", None, 3.5)]


def test_replicates_and_grid(spark, tmp_path):
    spark.range(5).selectExpr("id", "id % 2 AS replicate").write.partitionBy("replicate").parquet(str(tmp_path / "r"))
    assert matrices.read_replicates(spark, str(tmp_path / "r"), {0: 3, 1: 2}).count() == 5
    with pytest.raises(ValueError):
        matrices.read_replicates(spark, str(tmp_path / "r"), {0: 3, 1: 3})
    with pytest.raises(ValueError):
        matrices.require_grid(spark.range(3), spark.range(4), "id")


def test_gff_and_fasta(spark, tmp_path):
    g = tmp_path / "a.gff"
    g.write_text("#h\nc1\ts\texon\t10\t20\t.\t+\t.\tName=A_CDS;x=1\nc1\ts\texon\t30\t40\t.\t+\t.\tName=A_CDS\nc1\ts\tgene\t1\t9\t.\t+\t.\tName=B\n")
    assert [tuple(r) for r in annotation.read_gff_genes(spark, str(g)).collect()] == [("A", "c1", 10, 40, "+")]
    f = tmp_path / "a.fa"
    f.write_text(">c1 note\nacgt\nNNry\n>c2\nTTTT\n")
    chrom = annotation.read_fasta(spark, str(f))
    assert sorted(tuple(r) for r in chrom.collect()) == [("c1", "ACGTNNRY"), ("c2", "TTTT")]
    clean = {r.seqid: (r.seq, r.replaced) for r in sequences.unknown_bases(chrom).collect()}
    assert clean["c1"] == ("ACGTNNNN", 2)
    cut = spark.createDataFrame([("g", "c1", "-", 1, 4)], "gene string, seqid string, strand string, p_start long, p_end long")
    assert sequences.cut_sequences(cut, chrom).first().seq == "ACGT"
