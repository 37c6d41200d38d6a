"""Readers and writers: round trips of text formats, and streams against batches."""

from pyspark.sql import functions as F

from strandlake.operators import islands
from strandlake.schema import ALIGNMENT, VARIANT
from strandlake.sources import readers, writers
from strandlake.streaming import tables


def test_sam_round_trip(spark, tmp_path):
    rows = [("b1", 0, "ref", 0, 40, "3=", "ACA", [2, 1, 4], {"AA": "1"}), ("b2", 16, "ref", 4, 10, "2=1D1=", "CAG", [0, 1, 4], {"DT": "r9"})]
    df = spark.createDataFrame(rows, ALIGNMENT)
    writers.sam(df.coalesce(1), str(tmp_path / "sam"))
    back = readers.sam(spark, str(tmp_path / "sam")).orderBy("pos").collect()
    assert [tuple(r) for r in back] == rows


def test_sam_header(spark, tmp_path):
    (tmp_path / "x.sam").write_text("@HD\tVN:1.6\n@SQ\tSN:c1\tLN:100\n@RG\tID:g1\tDS:basecall_model=abc\n")
    head = readers.sam_header(spark, str(tmp_path / "x.sam"))
    assert readers.contigs(head).collect()[0].length == 100
    assert readers.read_groups(head).first().read_group == "g1"


def test_fasta_fastq_bed(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a first one\nACGT\nAC\n>b\nTT\n")
    got = {r.name: (r.comment, r.seq, r.length) for r in readers.fasta(spark, str(tmp_path / "x.fa")).collect()}
    assert got == {"a": ("first one", "ACGTAC", 6), "b": ("", "TT", 2)}
    (tmp_path / "x.fq").write_text("@r1 c\nACGT\n+\n!!!!\n@r2\nAC\n+\n@#\n")
    assert [(r.name, r.seq, r.qual) for r in readers.fastq(spark, str(tmp_path / "x.fq")).collect()] == [("r1", "ACGT", "!!!!"), ("r2", "AC", "@#")]
    (tmp_path / "x.bed").write_text("track name=x\nc1\t5\t9\nbad\n c2 1 3 label\n")
    assert [tuple(r) for r in readers.bed(spark, str(tmp_path / "x.bed")).collect()] == [("c1", 5, 9), ("c2", 1, 3)]


def test_vcf(spark, tmp_path):
    text = '##INFO=<ID=DP,Number=1,Type=Integer,Description="Total depth">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\nc1\t5\t.\ta\tC,G\t7.5\tPASS\tDP=3;DB\tGT:GQ\t1|2:9\nc1\t3\tx\tA\tT\t.\tq1;q2\t.\n'
    (tmp_path / "x.vcf").write_text(text)
    records = readers.vcf(spark, str(tmp_path / "x.vcf"))
    first = records.where("pos = 4").first()
    assert (first.ref, first.alt, first.qual, first.info, [tuple(g) for g in first.genotype]) == ("A", ["C", "G"], 7.5, {"DP": "3", "DB": ""}, [("GT", "1|2"), ("GQ", "9")])
    assert readers.vcf_header(spark, str(tmp_path / "x.vcf")).first().description == "Total depth"
    assert readers.unsorted_records(records.withColumn("n", F.monotonically_increasing_id()), "n").count() == 1
    assert readers.fetch(records, "c1", 4, 9).count() == 1 and readers.fetch(records, "c1", 0, 3, "contained").count() == 1
    lines = [r.line for r in writers.vcf_lines(records).orderBy("pos").collect()]
    assert lines == ["c1\t3\tx\tA\tT\t.\tq1;q2\t.", "c1\t5\t.\tA\tC,G\t7.500\tPASS\tDB;DP=3\tGT:GQ\t1|2:9"]
    assert set(spark.createDataFrame([], VARIANT).columns) == set(records.columns)
    writers.vcf(records, str(tmp_path / "out"), ["##FORMAT=<ID=GT>", "##INFO=<ID=DP>"])
    head = [r.value for r in spark.read.text(str(tmp_path / "out/header")).collect()]
    assert head[0].startswith("##INFO") and head[-1].startswith("#CHROM")


def test_chunk_store(spark, tmp_path):
    rows = [("c1", "s1", m, 0) for m in range(10)] + [("c1", "s2", m, 0) for m in range(100, 110)] + [("c1", "s1", 0, 0)]
    df = spark.createDataFrame(rows, "ref_name string, sample_id string, major long, minor long")
    writers.chunk_store(df, str(tmp_path / "store"))
    assert readers.chunk_store(spark, str(tmp_path / "store")).count() == 20
    region = spark.createDataFrame([("c1", 105, 300)], "ref_name string, start long, end long")
    assert {r.sample_id for r in readers.chunk_store(spark, str(tmp_path / "store"), region).collect()} == {"s2"}


def test_streams_equal_batches(spark, tmp_path):
    rows = [("u1", k, "AAABBC"[k % 6]) for k in range(30)] + [("u2", k, "XY"[k // 20]) for k in range(40)]
    df = spark.createDataFrame(rows, "ref_name string, k long, symbol string")
    for part in range(4):
        df.where(f"k >= {part * 10} and k < {part * 10 + 10}").coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = tables.streaming_runs(source, "ref_name", "k", "symbol").writeStream.format("memory").queryName("runs").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.ref_name, r.start, r.length, r.value) for r in spark.sql("select * from runs").collect()}
    batch = {(r.ref_name, r.start, r.length, r.value) for r in islands.run_length(df, ["ref_name"], ["k"], "symbol").collect()}
    open_runs = {max((r for r in batch if r[0] == key), key=lambda r: r[1]) for key in ("u1", "u2")}
    assert got == batch - open_runs


def test_metadata_files_and_tables(spark, tmp_path):
    df = spark.createDataFrame([("r1", 1), ("r2", 2)], "name string, n int")
    writers.metadata(df, {"model": "x", "scheme": "haploid"}, str(tmp_path / "meta"))
    assert readers.metadata(spark, str(tmp_path / "meta")) == {"model": "x", "scheme": "haploid"}
    for k in "ab":
        df.coalesce(1).write.csv(str(tmp_path / k), sep="\t", header=True)
    writers.concat_tsv([str(tmp_path / "a"), str(tmp_path / "b")], df, str(tmp_path / "both"))
    assert spark.read.csv(str(tmp_path / "both"), sep="\t", header=True).count() == 4
    (tmp_path / "m1.fa").write_text(">s1\nAC\nGT\n>s2\nGG\n")
    (tmp_path / "m2.fa").write_text(">s1\nTT\n")
    got = {(r.read_id.rsplit("/")[-1], r.subread, r.seq) for r in readers.file_reads(spark, str(tmp_path / "*.fa")).collect()}
    assert got == {("m1.fa", "s1", "ACGT"), ("m1.fa", "s2", "GG"), ("m2.fa", "s1", "TT")}


def test_read_groups_and_models(spark):
    import pytest

    groups = spark.createDataFrame([("a", "x basecall_model=m@v1 y"), ("b", "basecall_model=m")], "read_group string, description string")
    with pytest.raises(ValueError):
        readers.check_read_group(groups, None)
    with pytest.raises(ValueError):
        readers.check_read_group(groups, "c")
    readers.check_read_group(groups, "b")
    assert [r.model for r in readers.without_shorter_names(readers.basecallers(groups)).collect()] == ["m@v1"]


def test_subreads(spark):
    rows = [(f"m_1_{k}", "", "ACGT" * (k + 1)) for k in range(3)] + [("n_0", "", "AC")]
    kept = readers.subreads(spark.createDataFrame(rows, "name string, comment string, seq string"), 3, 7)
    assert {r.read_id for r in kept.collect()} == {"m_1"} and kept.count() == 3
