"""Gene annotation and sequences in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GFF = "seqid string, source string, type string, start long, end long, score string, strand string, phase string, attributes string"


def read_gff_genes(spark: SparkSession, path: str, feature_type: str = "exon", id_field: str = "Name", suffix: str = "_CDS") -> DataFrame:
    """(gene, seqid, start, end, strand): fragments of one gene joined to their least start and greatest end."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema=GFF).where(F.col("type") == feature_type)
    name = F.regexp_extract("attributes", rf"(?:^|;)\s*{id_field}=([^;]*)", 1)
    gene = F.regexp_replace(name, rf"{suffix}$", "")
    return rows.where(name != "").groupBy(gene.alias("gene")).agg(
        F.min_by("seqid", "start").alias("seqid"), F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("strand", "start").alias("strand")
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seqid, seq): names up to the first white space, sequences in upper case without line ends."""
    records = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    head = F.substring_index("value", "\n", 1)
    body = F.expr("substring(value, length(substring_index(value, '\n', 1)) + 2)")
    return records.select(F.regexp_extract(head, r"^(\S+)", 1).alias("seqid"), F.upper(F.regexp_replace(body, r"\s", "")).alias("seq"))
