"""Records of tandem repeats from reads of two haplotypes, allele bounds, metrics and training vectors."""

from pyspark.sql import functions as F

from strandlake.operators import labels, tandem
from strandlake.plans import repeats
from strandlake.schema import ALIGNMENT
from strandlake.sources import writers

LEFT, RIGHT = "GATTACAGGCTTAACCGTGA", "TTGACCATGGTCAATCGGAT"
REF = LEFT + "CAG" * 4 + RIGHT


def test_aligned_alleles(spark):
    rows = [("=", "20=", 0, 5, 9), ("gone", "5=10D5=", 0, 6, 12), ("one", "5=10D5=", 0, 4, 8), ("ins", "6=3I14=", 0, 5, 9), ("off", "20=", 100, 5, 9), ("clip", "2S20=", 0, 5, 9)]
    df = spark.createDataFrame(rows, "k string, cigar string, pos long, s long, e long").withColumn("seq", F.lit("ACGTACGTACGTACGTACGTAC"))
    bounds = tandem.aligned_bounds(F.col("cigar"), F.col("pos"), F.col("s"), F.col("e"))
    got = {r.k: r.a for r in df.select("k", tandem.bounded_allele(F.col("seq"), bounds).alias("a")).collect()}
    assert got == {"=": "CGTA", "gone": "<DEL>", "one": "A", "ins": "CGTACGT", "off": "<DEL>", "clip": "TACG"}


def test_records_of_two_haplotypes(spark):
    long, snp = LEFT + "CAG" * 6 + RIGHT, LEFT + "CAGCAGCTGCAG" + RIGHT
    tags = lambda hap: {"HP": str(hap), "PS": "7"}
    rows = [(f"a{k}", 0, "c", 0, 60, f"20=6I{len(REF) - 20}=", long, [30] * len(long), tags(1)) for k in range(4)]
    rows += [(f"b{k}", 0, "c", 0, 60, "27=1X24=", snp, [30] * len(snp), tags(2)) for k in range(3)]
    rows += [("other", 0, "c", 0, 60, f"{len(REF)}=", REF, [30] * len(REF), {"HP": "1", "PS": "9"}), ("untold", 0, "c", 0, 60, f"{len(REF)}=", REF, [30] * len(REF), {})]
    regions = spark.createDataFrame([("c", 20, 32), ("c", 20, 32), ("c", 900, 950)], "ref_name string, start long, end long")
    reference = spark.createDataFrame([("c", REF)], "ref_name string, seq string")
    reads = repeats.phased_reads(spark.createDataFrame(rows, ALIGNMENT), regions, "tags").cache()
    found = repeats.haplotypes(reads, reference, rounds=1)
    whole = repeats.records(found, reads, read_names=True).collect()
    assert [(r.chrom, r.pos, r.id, r.ref, r.alt) for r in whole] == [("c", 20, "c_20_32", "CAG" * 4, ["CAG" * 6, "CAGCAGCTGCAG"])]
    assert [(g.k, g.v) for g in whole[0].genotype] == [("GT", "1|2"), ("SD", "4,3"), ("ALLR", "38-38,32-32"), ("MAD", "0.00,0.00"), ("PS", "7")]
    assert whole[0].info == {"read_names_hap1": "a0,a1,a2,a3", "read_names_hap2": "b0,b1,b2"}
    events = repeats.records(found, reads, "decompose").orderBy("pos").collect()
    assert [(r.genotype[0].v, r.genotype[1].v, len(r.alt[0]) - len(r.ref)) for r in events] == [("1|0", "4", 6), ("0|1", "3", 0)]
    snps = [(r.pos, r.ref, r.alt, r.id) for r in events if len(r.ref) == len(r.alt[0])]
    assert snps == [(27, "A", ["T"], "c_20_32_27_hap2")]


def test_record_calls(spark):
    alleles = [("h", 1, 3, 0, "AC", "AA", 0), ("r", 1, 3, 0, "AA", "AA", 5), ("one", 1, 3, 1, "AC", "AA", 5), ("two", 1, 3, 2, "AA", "AA", 0), ("both", 1, 3, 1, "AA", "AA", 5), ("both", 1, 3, 2, "AC", "AA", 6)]
    reads = spark.createDataFrame([("h", 1, 3, 0, "x", n) for n in (2, 2, 5)], "ref_name string, start long, end long, hap int, qname string, length int")
    df = spark.createDataFrame(alleles, "ref_name string, start long, end long, hap int, allele string, ref string, phase_set long")
    got = {r.chrom: r for r in tandem.replacement_records(df, reads).collect()}
    assert {c: (r.genotype[0].v, r.alt) for c, r in got.items()} == {"h": ("1/1", ["AC"]), "r": ("0/0", []), "one": ("1|.", ["AC"]), "two": ("./0", []), "both": ("0/1", ["AC"])}
    assert [(g.k, g.v) for g in got["h"].genotype] == [("GT", "1/1"), ("SD", "3"), ("ALLR", "2-5"), ("MAD", "0.00")]
    assert [g.k for g in got["one"].genotype] == ["GT", "SD", "ALLR", "MAD", "PS"]
    assert tandem.replacement_records(df.limit(0), reads).count() == 0


def test_metrics(spark, tmp_path):
    reads = spark.createDataFrame([("chr10", 1, 9, 1, "a", 4), ("chr10", 1, 9, 2, "b", 6), ("chr2", 1, 9, 0, "c", 5)], "ref_name string, start long, end long, hap int, qname string, length int")
    both = tandem.region_metrics(reads, "prephased").unionByName(tandem.region_metrics(reads.where("hap = 0"), "unphased"))
    writers.metrics(both, str(tmp_path / "m"))
    lines = spark.read.text(str(tmp_path / "m/phasing_method=prephased")).collect()
    assert [r.value.split("\t")[:5] for r in lines] == [["ref_name", "start", "end", "depth", "shortest"], ["chr2", "1", "9", "1", "5"], ["chr10", "1", "9", "2", "4"]]
    assert spark.read.csv(str(tmp_path / "m/phasing_method=unphased"), sep="\t", header=True).count() == 1


def test_training_vectors(spark):
    rows = spark.createDataFrame([("s", 2, 0, 4), ("s", 1, 1, 0), ("s", 1, 0, 3)], "sample_id string, major long, minor long, label int")
    assert labels.training_vectors(rows, ["sample_id"], ["major", "minor"]).first().truth == [[3], [0], [4]]
    old = rows.withColumn("label", F.struct(F.col("label").alias("code"), F.lit(2).alias("run")))
    assert labels.training_vectors(old, ["sample_id"], ["major", "minor"], legacy=True).first().truth == [[0], [0], [0]]
