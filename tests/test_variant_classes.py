"""Classes of variants by lengths and shared end bases; all cases in one job."""

from pyspark.sql import functions as F

from strandlake.operators import variants

# What each reference allele and its alternatives must be called.
CASES = [
    ("snp", "G", ["A"]),
    ("mnp", "GG", ["AT"]),
    ("mnp", "GA", ["CT", "CA"]),
    ("sni", "G", ["GT"]),
    ("sni", "G", ["AG"]),
    ("mni", "G", ["GTC"]),
    ("mni", "G", ["ATG"]),
    ("mni", "G", ["GG", "GGG"]),
    ("mni", "AC", ["AGCT"]),
    ("mni", "AC", ["GGAC"]),
    ("snd", "GA", ["G"]),
    ("snd", "GA", ["A"]),
    ("snd", "ACG", ["CG"]),
    ("mnd", "GAT", ["G"]),
    ("mnd", "GAA", ["A"]),
    ("mnd", "GGG", ["G", "GG"]),
    ("mnd", "ACGT", ["AT"]),
    ("indel", "GG", ["G", "GGA"]),
    ("other", "G", ["ATA"]),
    ("other", "G", ["TGC"]),
    ("other", "GAC", ["T"]),
    ("other", "GAT", ["A"]),
    ("other", "AC", ["TGGG"]),
    ("other", "GA", ["GT", "GAA"]),
    ("other", "GA", ["G", "AA"]),
]


def test_classes(spark):
    df = spark.createDataFrame(CASES, "want string, ref string, alts array<string>")
    got = df.withColumn("got", variants.classify(F.col("ref"), F.col("alts"))).where("want != got").collect()
    assert not got
