"""Operators against small worked examples."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import sequences as S
from strandlake.operators import align, consensus, intervals, islands, labels, pileup, read_matrix, reads, tandem, variants
from strandlake.schema import ALIGNMENT, INTERVAL

READS = [
    ("b1", 0, "ref", 0, 40, "8=", "ACATGATG", [2, 1, 4, 5, 1, 1, 2, 1], {"AA": "1", "DT": "r9"}),
    ("b2", 0, "ref", 0, 10, "3=1D4=", "ACAGATG", [0, 1, 4, 1, 1, 1, 2], {"AA": "1", "DT": "r9"}),
    ("b3", 16, "ref", 0, 16, "4=1I4=", "ACATAGATG", [2, 1, 4, 5, 1, 1, 1, 2, 1], {"AA": "2", "DT": "r9"}),
    ("b4", 16, "ref", 0, 24, "3=1X4=", "ACACGATG", [2, 1, 4, 1, 1, 1, 2, 1], {"DT": "r10"}),
]


@pytest.fixture(scope="module")
def alignments(spark):
    return spark.createDataFrame(READS, ALIGNMENT)


def observed(df):
    return reads.observations(reads.primary(df)).withColumn("is_rev", F.col("flag").bitwiseAND(reads.REVERSE) > 0)


def test_pileup(alignments):
    pile = {(r.major, r.minor): [r[c] for c in pileup.COUNTS] for r in pileup.counts(observed(alignments)).collect()}
    two = lambda k: [2 * (i in (k, k + 4)) for i in range(10)]
    assert pile == {
        (0, 0): two(0), (1, 0): two(1), (2, 0): two(0), (3, 0): [0, 1, 0, 1, 0, 0, 0, 1, 0, 1], (3, 1): [1] + [0] * 9,
        (4, 0): two(2), (5, 0): two(0), (6, 0): two(3), (7, 0): two(2),
    }


def test_pileup_does_not_depend_on_partitions(alignments):
    one = pileup.counts(observed(alignments)).orderBy("major", "minor").collect()
    assert one == pileup.counts(observed(alignments.repartition(7))).orderBy("major", "minor").collect()


def test_symmetric_indels(alignments):
    norm = pileup.normalise_total(pileup.symmetric_indels(pileup.counts(observed(alignments))))
    row = norm.where("major = 3 and minor = 1").first()
    assert (row.rev_del, row.fwd_del, row.rev_a) == (0.25, 0.5, 0.25)


def test_tags_and_groups(alignments):
    assert reads.with_tag(alignments, "AA", 1).count() == 2
    assert reads.with_tag(alignments, "AA", 1, keep_missing=True).count() == 3
    assert reads.of_read_group(alignments, "x").count() == 0
    with pytest.raises(ValueError):
        reads.with_tag(alignments, "AAA", 1)


def test_consensus_of_toy(alignments):
    decoded = consensus.decode(pileup.majority_probs(pileup.counts(observed(alignments))))
    assert consensus.sequences(decoded, ["ref_name"]).first().seq == "ACATGATG"


def test_soft_clips_and_skips(spark):
    row = ("x", 0, "r", 10, 60, "2S2=1N1D1I1=3S", "TTACGTAAA", list(range(9)), {})
    got = [(r.major, r.minor, r.symbol) for r in observed(spark.createDataFrame([row], ALIGNMENT)).orderBy("major", "minor").collect()]
    assert got == [(10, 0, "A"), (11, 0, "C"), (13, 0, "*"), (13, 1, "G"), (14, 0, "T")]


def test_read_matrix(alignments):
    spans = alignments.select("ref_name", "qname", F.col("pos").alias("start"), S.reference_end(F.col("pos"), F.col("cigar")).alias("end"))
    cells = read_matrix.tensors(read_matrix.matrix(observed(alignments), read_matrix.assign_rows(spans))).orderBy("major", "minor").collect()
    assert [len(c.reads) for c in cells] == [4, 4, 4, 4, 1, 4, 4, 4, 4]
    assert [c.base for c in cells[3].reads] == [4, 5, 4, 2] and cells[3].reads[1].qual == -1


def frame(spark, items, name="r"):
    return spark.createDataFrame([(name, a, b) for a, b in items], INTERVAL)


def spans_of(df):
    return [(r.start, r.end) for r in df.orderBy("start", "end").collect()]


def test_merge(spark):
    got = intervals.merge(frame(spark, [(0, 1001), (900, 1901), (1900, 3001), (3001, 3501), (3502, 4001)]), ["ref_name"])
    assert spans_of(got) == [(0, 3501), (3502, 4001)]


@pytest.mark.parametrize(
    ("length", "held", "gaps"),
    [(25, [(0, 5), (6, 7), (10, 12), (16, 25)], [(5, 6), (7, 10), (12, 16)]), (20, [(3, 7), (11, 15)], [(0, 3), (7, 11), (15, 20)]), (9, [], [(0, 9)])],
)
def test_complement(spark, length, held, gaps):
    lengths = spark.createDataFrame([("r", length)], "ref_name string, length long")
    assert spans_of(intervals.complement(frame(spark, held), lengths, ["ref_name"])) == gaps


@pytest.mark.parametrize(
    ("items", "least", "left"),
    [
        ([(2000, 2999), (2500, 3000)], 1000, []),
        ([(5000, 5999), (5900, 6401)], 401, [(5000, 5900), (5999, 6401)]),
        ([(5000, 5999), (5900, 6401)], 899, [(5000, 5900)]),
        ([(7000, 8000), (7501, 8000)], 1000, [(7000, 8000)]),
        ([(0, 1000), (100, 200)], 1000, [(0, 1000)]),
        ([(3000, 4000), (3800, 4299)], 298, [(3000, 4000), (4000, 4299)]),
    ],
)
def test_arbitrate(spark, items, least, left):
    rows = spark.createDataFrame([("r", k, a, b) for k, (a, b) in enumerate(items)], "ref_name string, id long, start long, end long")
    assert spans_of(intervals.arbitrate(rows, ["ref_name"], "id", least)) == left


def test_overlap_join_is_all_pairs(spark):
    rng = random.Random(3)
    items = [(k, a := rng.randrange(500), a + rng.randrange(1, 90)) for k in range(120)]
    df = spark.createDataFrame([("r", *i) for i in items], "ref_name string, id long, start long, end long")
    got = {(r.a_id, r.b_id) for r in intervals.overlap_join(df, df, ["ref_name"], 16).collect()}
    assert got == {(x[0], y[0]) for x in items for y in items if x[1] < y[2] and x[2] > y[1]}


def test_region_split(spark):
    fixed = spans_of(intervals.split_regions(frame(spark, [(50, 100)]), 7))
    assert fixed[-2:] == [(92, 99), (93, 100)]
    assert spans_of(intervals.split_regions(frame(spark, [(50, 100)]), 7, fixed=False))[-1] == (99, 100)


def test_depth_runs(spark):
    depth = [2, 3, 10, 10, 4, 13, 10, 8, 10, 9, 1]
    rows = spark.createDataFrame([("s", i, d) for i, d in enumerate(depth)], "s string, i long, d long")
    assert spans_of(islands.depth_runs(rows, ["s"], ["i"], "d", 10)) == [(2, 4), (5, 7), (8, 9)]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_sequences(spark):
    assert one(spark, S.reverse_complement(F.lit("AcNX"))) == "XNgT"
    assert tuple(one(spark, S.compress_homopolymers(F.lit("ACCGTTTAC")))) == ("ACGTAC", "\"#\"$\"\"")
    assert one(spark, S.compress_homopolymers(F.lit("ACCCCCCCGTTTA"), block=3)).seq == "ACCCGTA"
    assert tuple(one(spark, S.trim_cigar_start(F.lit("1I2X5=")))) == ("5=", 3, 2)
    assert one(spark, S.add_clipping(F.lit("4S2=3S"), 4, 8)) == "8S2=11S"
    assert one(spark, S.info_to_string(S.string_to_info(F.lit("B=2;A;C=x,y")))) == "A;B=2;C=x,y"
    assert tuple(one(spark, S.region_parse(F.lit("c:-10")))) == ("c", 0, 10)
    assert tuple(one(spark, S.region_parse(F.lit("c:10-")))) == ("c", 10, None)
    assert tuple(one(spark, S.region_parse(F.lit("c")))) == ("c", None, None)
    assert one(spark, S.natural_key(F.lit("chr2"))) < one(spark, S.natural_key(F.lit("chr10")))
    assert one(spark, S.move_table_dwells(F.array(*map(F.lit, [1, 0, 1, 1, 0, 0])), F.lit(5), F.lit(False))) == [10, 5, 15]


def test_decode_probabilities(spark):
    probs = [[0.0, 1.0, 0.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0, 0.0], [0.25, 0.5, 0.25, 0.0, 0.0]]
    rows = spark.createDataFrame([("r", i, 0, p) for i, p in enumerate(probs)], "ref_name string, major long, minor long, probs array<double>")
    got = consensus.sequences(consensus.decode(rows), ["ref_name"]).first()
    assert got.seq == "AA" and got.qual == chr(70 + 33) + chr(3 + 33)


@pytest.mark.parametrize(
    ("ref", "alts", "kind"),
    [("A", ["C"], "snp"), ("AC", ["GT"], "mnp"), ("A", ["AC"], "sni"), ("A", ["ACT"], "mni"), ("AC", ["A"], "snd"), ("ACT", ["A"], "mnd"), ("A", ["C", "AC"], "other"), ("AC", ["A", "ACT"], "indel")],
)
def test_classify(spark, ref, alts, kind):
    assert one(spark, variants.classify(F.lit(ref), F.array(*map(F.lit, alts)))) == kind


def test_trim_and_left_align(spark):
    assert tuple(one(spark, variants.trim(F.lit(5), F.lit("ACGT"), F.lit("ATGT")))) == (6, "C", "T")
    assert tuple(one(spark, variants.trim(F.lit(5), F.lit("AAA"), F.lit("AA")))) == (5, "AA", "A")
    records = spark.createDataFrame([("c", 7, "CA", "C")], "chrom string, pos long, ref string, alt string")
    reference = spark.createDataFrame([("c", "GGCACACACACT")], "chrom string, seq string")
    got = variants.left_align(records.withColumn("ref", F.lit("ACA")).withColumn("alt", F.lit("A")).withColumn("pos", F.lit(7).cast("long")), reference).first()
    assert (got.pos, got.ref, got.alt) == (1, "GCA", "G")


def test_merge_haplotypes(spark):
    schema = "chrom string, pos long, ref string, alt string, qual double"
    h1 = spark.createDataFrame([("c", 2, "G", "T", 10.0), ("c", 8, "A", "C", 20.0)], schema)
    h2 = spark.createDataFrame([("c", 2, "G", "T", 20.0), ("c", 5, "A", "G", 30.0)], schema)
    reference = spark.createDataFrame([("c", "ACGTCATTAG")], "chrom string, seq string")
    got = [(r.pos, r.ref, r.alt, r.gt, r.qual) for r in variants.merge_haplotypes(h1, h2, reference).orderBy("pos").collect()]
    assert got == [(2, "G", ["T"], "1|1", 15.0), (5, "A", ["G"], "0|1", 30.0), (8, "A", ["C"], "1|0", 20.0)]


def test_homozygous_and_haplotypes(spark):
    rows = spark.createDataFrame([("c", 0), ("c", 1000), ("c", 1500)], "chrom string, pos long")
    assert [(r.start, r.end) for r in variants.homozygous_gaps(rows).collect()] == [(0, 1000)]
    records = spark.createDataFrame([("c", 2, "G", ["T"])], "chrom string, pos long, ref string, alt array<string>")
    reference = spark.createDataFrame([("c", "ACGTCA")], "chrom string, seq string")
    assert variants.padded_haplotypes(records, reference, 2).first().haps == ["ACGTC", "ACTTC"]


def chunk(name, majors, minors=()):
    return [("r", name, m, 0) for m in majors] + [("r", name, m, 1) for m in minors]


def test_trim_chunks(spark):
    schema = "ref_name string, sample_id string, major long, minor long"
    rows = chunk("a", range(0, 10)) + chunk("b", range(6, 16)) + chunk("inside", range(7, 9)) + chunk("d", range(30, 33))
    got = consensus.trim_chunks(spark.createDataFrame(rows, schema)).groupBy("sample_id", "piece").agg(F.min("major"), F.max("major")).orderBy("sample_id").collect()
    assert [tuple(r) for r in got] == [("a", 1, 0, 7), ("b", 1, 8, 15), ("d", 2, 30, 32)]


def test_trim_chunks_with_other_columns(spark):
    rows = chunk("a", range(0, 10), [7]) + chunk("b", range(4, 14))
    kept = consensus.trim_chunks(spark.createDataFrame(rows, "ref_name string, sample_id string, major long, minor long"))
    places = [(r.major, r.minor) for r in kept.where("minor = 0").orderBy("major").collect()]
    assert places == [(m, 0) for m in range(14)]


def test_stitch_and_fill(spark):
    pieces = spark.createDataFrame([("c", 2, 4, "GGG")], "ref_name string, start long, stop long, seq string")
    draft = spark.createDataFrame([("c", "AAAAAAAA"), ("d", "TT")], "ref_name string, seq string")
    assert {(r.ref_name, r.seq) for r in consensus.fill_gaps(pieces, draft).collect()} == {("c", "AAGGGAAA"), ("d", "TT")}
    assert consensus.fill_gaps(pieces, draft, "N").where("ref_name = 'c'").first().seq == "NNGGGNNN"


def test_alignment_scores():
    read = "ATGCTTTTTGCTAC"
    assert align.align_pair(read, read)[0] == 14 * 5
    assert align.align_pair(read, read.replace("GCTAC", "GATAC"))[0] == 13 * 5 - 4
    assert align.align_pair("ATGCTTTTGCTAC", read)[0] == 13 * 5 - 5
    assert align.align_pair("ATGCTTTGCTAC", read)[0] == 12 * 5 - 5 - 3


def test_global_alignment_is_optimal():
    rng = random.Random(5)

    def best(q, r):
        low = -(10**9)
        h, d, i = {(0, 0): 0}, {}, {}
        for x in range(len(q) + 1):
            for y in range(len(r) + 1):
                if (x, y) == (0, 0):
                    continue
                d[x, y] = max(h.get((x, y - 1), low) - 5, d.get((x, y - 1), low) - 3)
                i[x, y] = max(h.get((x - 1, y), low) - 5, i.get((x - 1, y), low) - 3)
                m = h.get((x - 1, y - 1), low) + ((5 if q[x - 1] == r[y - 1] else -4) if x and y else low)
                h[x, y] = max(m, d[x, y], i[x, y])
        return h[len(q), len(r)]

    for _ in range(40):
        q, r = ("".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 14))) for _ in range(2))
        score, _, cigar = align.align_pair(q, r, "global")
        assert score == best(q, r)
        ops = __import__("re").findall(r"(\d+)(\D)", cigar)
        assert sum(int(n) for n, o in ops if o in "=XI") == len(q) and sum(int(n) for n, o in ops if o in "=XD") == len(r)
        parts = sum(-(5 + 3 * (int(n) - 1)) if o in "DI" else (5 if o == "=" else -4) * int(n) for n, o in ops)
        assert parts == score


def test_star_consensus_and_orientation(spark):
    rows = [("m", "ACGTACGTTA"), ("m", "ACGTACGTTA"), ("m", "ACGTCGTTA")]
    assert align.star_consensus(spark.createDataFrame(rows, "read string, seq string"), ["read"]).first().seq == "ACGTACGTTA"
    sub = spark.createDataFrame([("ACGTTTGC", "ACGTTTGC"), ("GCAAACGT", "ACGTTTGC")], "seq string, template string")
    assert [(r.seq, r.is_rev) for r in align.orient(sub).collect()] == [("ACGTTTGC", False), ("ACGTTTGC", True)]


def test_tandem(spark):
    call = one(spark, tandem.genotype(F.lit("A"), F.array(F.lit("C"), F.lit("G"))))
    assert (call.gt, call.alt) == ("1|2", ["C", "G"])
    assert one(spark, tandem.genotype(F.lit("A"), F.array(F.lit("C"), F.lit(None)))).gt == "1|."
    rows = spark.createDataFrame([("g", 1, s) for s in (10, 11, 30, 31)], "g string, hap int, n long")
    assert [r.cluster for r in tandem.two_clusters(rows, ["g"], "n").orderBy("n").collect()] == [1, 1, 2, 2]


def test_label_classes(spark):
    assert len(labels.haploid_classes()) == 5 and len(labels.diploid_classes()) == 15 and len(labels.run_length_classes()) == 49
    assert one(spark, labels.encode(F.lit("G"), labels.haploid_classes())) == 3


def test_run_coordinates(spark):
    seq = F.lit("CCCTAGGTTA")
    assert one(spark, S.run_starts(seq)) == [0, 3, 4, 5, 7, 9]
    assert [one(spark, S.run_of(F.lit(k), seq)) for k in (0, 2, 3, 9)] == [0, 0, 1, 5]


def test_variants_of_a_read(spark):
    row = ("q", 0, "ref", 0, 60, "3=1X2=1I1=1D1=", "ACATAGTCG", list(range(9)), {})
    reference = spark.createDataFrame([("ref", "ACAGAGCTG")], "ref_name string, seq string")
    got = [(r.pos, r.ref, r.alt) for r in variants.from_observations(observed(spark.createDataFrame([row], ALIGNMENT)), reference).orderBy("pos").collect()]
    assert got == [(3, "G", "T"), (5, "G", "GT"), (6, "CT", "C")]


def test_decode_variants(spark):
    rows = [("r", 0, 0, "A", "A"), ("r", 1, 0, "C", "G"), ("r", 2, 0, "G", "G"), ("r", 2, 1, "*", "T"), ("r", 3, 0, "T", "T"), ("r", 4, 0, "A", "*"), ("r", 5, 0, "C", "C")]
    df = spark.createDataFrame(rows, "ref_name string, major long, minor long, ref_symbol string, symbol string").withColumns({"prob": F.lit(0.9), "ref_prob": F.lit(0.1)})
    got = [(r.pos, r.ref, r.alt) for r in variants.decode(df).orderBy("pos").collect()]
    assert got == [(1, "C", "G"), (2, "G", "GT"), (3, "TA", "T")]


def test_models(spark):
    import numpy as np

    from strandlake.operators import encoders

    rng = np.random.default_rng(0)
    layer = {f"{d}_{k}": rng.normal(size=s) for d in "fb" for k, s in (("w", (12, 10)), ("u", (12, 4)), ("bw", 12), ("bu", 12))}
    model = encoders.gru_model([layer], (rng.normal(size=(5, 8)), np.zeros(5)))
    chunks = spark.createDataFrame([(1, rng.random((6, 10)).tolist()), (2, rng.random((6, 10)).tolist()), (3, rng.random((4, 10)).tolist())], "k long, features array<array<double>>")
    got = {r.k: r.probs for r in encoders.predict(chunks, model, ["k"]).collect()}
    assert {k: len(p) for k, p in got.items()} == {1: 6, 2: 6, 3: 4}
    assert all(abs(sum(row) - 1) < 1e-6 for p in got.values() for row in p)
    with pytest.raises(KeyError):
        encoders.encode(chunks, {"type": "none"})
