import pytest
from pyspark.sql import functions as F

from regseq.plans.promoters import extract_promoters
from regseq.sources import readers, writers


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def test_fasta(spark, tmp_path):
    text = ">a first > one\nACG\nTN\n\n>b\r\nac\r\ngt\r\n>c empty\n"
    got = {r.id: (r.description, r.seq) for r in readers.read_fasta(spark, write(tmp_path / "x.fa", text)).collect()}
    assert got == {"a": ("first > one", "ACGTN"), "b": ("", "acgt"), "c": ("empty", "")}


def test_bed_and_rejects(spark, tmp_path):
    path = write(tmp_path / "x.bed", "c1\t1\t5\tg\t0\t+\nc1 2 6 h 0 -\nshort\t1\t2\n")
    assert [(r.chrom, r.lo, r.hi, r.name, r.strand) for r in readers.read_bed(spark, path).orderBy("lo").collect()] == [("c1", 1, 5, "g", "+"), ("c1", 2, 6, "h", "-")]
    assert tuple(readers.bed_rejects(spark, path).first()) == (1, 3)


def test_orthologs(spark, tmp_path):
    path = write(tmp_path / "o.tsv", "q.1\tt.2\tunknown\tunknown\nq2\tnone\tnone\tg\n")
    assert [tuple(r) for r in readers.read_orthologs(spark, path).collect()] == [("q.1", "t.2", "t", "q")]


def test_other_tables(spark, tmp_path):
    hits = readers.read_hits(spark, write(tmp_path / "h", "a\tx\na\ty\nb\tx\n"), 1)
    assert [tuple(r) for r in hits.collect()] == [("b", "x")]
    assert readers.read_chip_loci(spark, write(tmp_path / "c", "r\t5\tg\n")).first().strand == "+"
    assert [tuple(r) for r in readers.read_factor_map(spark, write(tmp_path / "f", "f\ta\nF1\tP1\nF2\tNONE\nF3\t\n")).collect()] == [("F1", "P1")]


GFF = """##gff
c1\tx\tgene\t11\t20\t.\t+\t.\tName=q;ID=gene:A
c1\tx\tCDS\t14\t18\t.\t+\t.\tParent=A
c1\tx\tgene\t31\t40\t.\t-\t.\tID=gene:B
c1\tx\tCDS\t33\t38\t.\t-\t.\tParent=B
"""


def test_promoter_chain(spark, tmp_path):
    gff = readers.read_gff3(spark, write(tmp_path / "x.gff3", GFF))
    seqs = spark.createDataFrame([("c1", "ACGTN" * 10)], "id string, seq string")
    got = {r.name: (r.lo, r.hi, r.seq) for r in extract_promoters(gff, seqs, "ID=gene:", 8).collect()}
    assert got == {"A": (2, 10, ("ACGTN" * 10)[2:10]), "B": (40, 48, ("ACGTN" * 10)[40:48][::-1].translate(str.maketrans("ACGT", "TGCA")))}
    cds = {r.name: (r.lo, r.hi) for r in extract_promoters(gff, seqs, "ID=gene:", 8, to_cds=True, trim=False).collect()}
    assert cds == {"A": (2, 13), "B": (38, 48)}
    with pytest.raises(ValueError, match="without"):
        extract_promoters(gff, seqs, "ID=x:", 8)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("g", 1, "s1", 0, 3, "ACGT", 9.0, 0.5, "p")], "gene_id string, bundle_id int, species string, start int, end int, seq string, conservation double, belief double, partner string")
    writers.write_cns_tabular(df, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "g\tp\tACGT\t9.0\t0.5\t"
    assert writers.cns_blocks(df).first()[0].split("\n") == ["--PairStart", "g", "", "s1", "p", "", "", "--RemoStart", "--InnerStart", "--Organism: s1", "ACGT", "+", "1", "4", "9.0", "0.5", "", "--InnerEnd", "--RemoEnd", "--PairEnd"]
    writers.write_cns_fasta(df, str(tmp_path / "f"))
    assert "gene_id=g" in str(list((tmp_path / "f").iterdir()))
    writers.write_cns_blocks(df, str(tmp_path / "b"))
    writers.write_alignmax(spark.createDataFrame([("p", 3), ("p", 5)], "pair_id string, score int"), str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).first()[0] == "p\t5"
    iv = spark.createDataFrame([("c", 1, 4, "n", "0", "+")], "chrom string, lo int, hi int, name string, score string, strand string")
    writers.write_bed(iv, str(tmp_path / "bed"))
    assert readers.read_bed(spark, str(tmp_path / "bed")).count() == 1
    writers.write_fasta(iv.select(F.col("name").alias("label"), F.col("lo").alias("five"), F.col("hi").alias("three"), F.lit("AC").alias("seq")), str(tmp_path / "fa"))
    assert readers.read_fasta(spark, str(tmp_path / "fa")).first().seq == "AC"
    assert tuple(writers.report_regions(df, 5.0).first()) == ("g", 1, 1, 1, 0.5)
    writers.write_orthologs(spark.createDataFrame([("q", None, None, None)], "query_protein string, target_protein string, target_gene string, query_gene string"), str(tmp_path / "o"))
    assert spark.read.csv(str(tmp_path / "o"), sep="\t").first()[1] == "none"
