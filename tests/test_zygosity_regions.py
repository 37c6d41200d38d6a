"""Homozygous and heterozygous stretches of regions."""

from strandlake.operators import variants


def test_stretches(spark):
    mixed = spark.createDataFrame([("c", 50, "A"), ("c", 100, "ACGTACGTAC"), ("c", 103, "A"), ("c", 130, "A"), ("c", 195, "ACGTACGTAC"), ("d", 5, "A")], "chrom string, pos long, ref string")
    regions = spark.createDataFrame([("c", 60, 200), ("c", 60, 200), ("e", 0, 30), ("e", 9, 9)], "chrom string, start long, end long")
    got = variants.zygosity_regions(mixed, regions, 20, 16).orderBy("chrom", "start").collect()
    # Bases 100 to 109 are taken, the record within them too, so the next stretch starts at 109; 109 to 130 has 21 bases.
    assert [(r.chrom, r.kind, r.start, r.end) for r in got] == [
        ("c", "homozygous", 60, 100),
        ("c", "homozygous", 109, 130),
        ("c", "homozygous", 130, 195),
        ("e", "homozygous", 0, 30),
    ]
    got = variants.zygosity_regions(mixed, regions, 40, 16).where("kind = 'heterozygous'").collect()
    assert not got
    got = variants.zygosity_regions(mixed, regions, 30, 16).orderBy("chrom", "start").collect()
    assert [(r.chrom, r.kind, r.start, r.end) for r in got] == [("c", "homozygous", 60, 100), ("c", "homozygous", 130, 195), ("e", "homozygous", 0, 30)]
    got = variants.zygosity_regions(mixed, regions, 25, 16).where("kind = 'heterozygous'").collect()
    assert [(r.start, r.end) for r in got] == [(100, 130)]
