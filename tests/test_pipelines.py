"""End-to-end jobs and commands on small made-up reads."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.__main__ import main
from strandlake.plans import pipelines
from strandlake.schema import ALIGNMENT
from strandlake.sources import readers, writers


@pytest.fixture(scope="module")
def reads(spark):
    """A reference of 300 bases, and exact reads of a sample that differs at 100 (SNP), 150 (insertion) and 200 (deletion)."""
    rng = random.Random(1)
    ref = "".join(rng.choice("ACGT") for _ in range(300))
    ref = ref[:100] + "A" + ref[101:149] + "GC" + ref[151:199] + "CAT" + ref[202:]
    rows = []
    for k in range(12):
        seq = ref[10:100] + "T" + ref[101:151] + "TT" + ref[151:200] + ref[201:290]
        rows.append((f"r{k}", 16 * (k % 2), "c1", 10, 60, "90=1X50=2I49=1D89=", seq, [30] * len(seq), {}))
    rows.append(("bad", 4, "c1", 10, 60, "5=", "AAAAA", [1] * 5, {}))
    reference = spark.createDataFrame([("c1", ref), ("c2", "ACGT")], "ref_name string, seq string")
    return spark.createDataFrame(rows, ALIGNMENT), reference, ref


def test_consensus_and_variants(reads):
    alignments, reference, ref = reads
    columns = pipelines.inference(alignments, config={"type": "counts", "kwargs": {"symmetric": True}}).cache()
    done = {r.ref_name: r.seq for r in pipelines.sequence(columns, reference).collect()}
    assert done == {"c1": ref[:100] + "T" + ref[101:151] + "TT" + ref[151:200] + ref[201:], "c2": "ACGT"}
    called = [(r.pos, r.ref, r.alt) for r in pipelines.call_variants(columns, reference).orderBy("pos").collect()]
    assert called == [(100, "A", "T"), (150, ref[150], ref[150] + "TT"), (199, ref[199:201], ref[199])]
    assert [(r.pos, r.gt) for r in pipelines.call_snps(columns, reference).where("gt <> '0/0'").collect()] == [(100, "1/1")]
    covered, gaps = pipelines.coverage(alignments, reference.select("ref_name", F.length("seq").alias("length")))
    assert [(r.start, r.end, r.n) for r in covered.collect()] == [(10, 290, 12)]
    assert {(r.ref_name, r.start, r.end) for r in gaps.collect()} == {("c1", 0, 10), ("c1", 290, 300), ("c2", 0, 4)}


def test_chunked_is_unchunked(reads, monkeypatch):
    alignments, reference, _ = reads
    config = {"type": "counts", "kwargs": {"symmetric": True}}
    whole = pipelines.sequence(pipelines.inference(alignments, config=config), reference).orderBy("ref_name").collect()
    monkeypatch.setattr(pipelines, "CHUNK", 60)
    monkeypatch.setattr(pipelines, "OVERLAP", 17)
    columns = pipelines.inference(alignments, config=config)
    assert columns.select("sample_id").distinct().count() > 4
    assert pipelines.sequence(columns, reference).orderBy("ref_name").collect() == whole


def test_consensus_to_reference(spark):
    pairs = spark.createDataFrame([("c", "ACGTACGTTTGACC", "ACGTACTTTGACC")], "ref_name string, query string, seq string")
    assert [(r.pos, r.ref, r.alt) for r in pipelines.variants_of_consensus(pairs).collect()] == [(5, "C", "CG")]
    runs = spark.createDataFrame([("n", "AACCGT", "TTTACGTT")], "name string, query string, ref string")
    found = pipelines.compressed_alignments(runs).first()
    assert (found.score, found.start, found.cigar) == (20, 3, "4=")


def test_molecules(spark):
    base = "ACGTTGCAACGGTTAACC"
    flip = base.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    rows = [("m", f"m_{k}", s) for k, s in enumerate([base + "A", base, flip, base])] + [("few", "few_0", base)]
    got = pipelines.molecules(spark.createDataFrame(rows, "read_id string, subread string, seq string")).collect()
    assert len(got) == 1 and got[0].n == 4 and got[0].seq in (base, flip)


def test_repeats(spark):
    ref = "ACGT" * 5 + "CAG" * 4 + "TTGA" * 5
    long = ref[:32] + "CAG" * 3 + ref[32:]
    rows = [(f"a{k}", 0, "c", 0, 60, f"{len(ref)}=", ref, [30] * len(ref), {}) for k in range(4)]
    rows += [(f"b{k}", 0, "c", 0, 60, f"31=9I{len(ref) - 31}=", ref[:31] + "CAGCAGCAG" + ref[31:], [30] * len(long), {}) for k in range(3)]
    regions = spark.createDataFrame([("c", 20, 32), ("c", 500, 600)], "ref_name string, start long, end long")
    reference = spark.createDataFrame([("c", ref)], "ref_name string, seq string")
    got = pipelines.repeats(spark.createDataFrame(rows, ALIGNMENT), regions, reference).collect()
    assert [(r.start, r.gt, r.n1, r.n2, [len(a) for a in r.alt]) for r in got] == [(20, "0|1", 4, 3, [21])]


def test_commands(spark, reads, tmp_path):
    alignments, reference, ref = reads
    path = lambda name: str(tmp_path / name)
    writers.sam(alignments.coalesce(1), path("in.sam"))
    writers.fasta(reference.withColumnRenamed("ref_name", "name").coalesce(1), path("ref.fa"))
    main(["inference", path("in.sam"), path("store")])
    main(["sequence", path("store"), path("out.fa"), "--reference", path("ref.fa")])
    assert {r.name for r in readers.fasta(spark, path("out.fa")).collect()} == {"c1", "c2"}
    main(["vcf", path("store"), path("calls"), "--reference", path("ref.fa")])
    calls = readers.vcf(spark, path("calls/*"))
    assert calls.where("pos = 100").first().alt == ["T"]
    main(["annotate", path("calls/*"), path("noted"), "--reads", path("in.sam")])
    assert readers.vcf(spark, path("noted/*")).where("pos = 100").first().info["DP"] == "12"
    main(["chunks_to_bed", path("store"), path("bed")])
    assert [tuple(r) for r in readers.bed(spark, path("bed")).collect()] == [("c1", 10, 290)]
    main(["classify", path("calls/*"), path("classes")])
    assert spark.read.text(path("classes/class_group=sub")).count() >= 1
    main(["vcf2tsv", path("calls/*"), path("tsv")])
    main(["homozygous_regions", path("calls/*"), path("homo")])
    main(["haploid2diploid", path("calls/*"), path("diploid"), "--other", path("calls/*"), "--reference", path("ref.fa")])
    assert readers.vcf(spark, path("diploid/*")).where("pos = 100").first().genotype[0].v == "1|1"
