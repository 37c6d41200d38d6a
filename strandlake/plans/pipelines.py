"""End-to-end jobs: alignments to probabilities, probabilities to sequences or variants, molecules and repeats to consensus."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import align, consensus, edit_align, encoders, intervals, islands, pileup, poa, reads, tandem, variants, windows

CHUNK, OVERLAP = 10_000, 1_000


def observations(alignments: DataFrame, min_mapq: int = 1) -> DataFrame:
    """Observed bases of primary alignments, with is_rev."""
    kept = reads.primary(alignments, min_mapq)
    return reads.observations(kept).withColumn("is_rev", F.col("flag").bitwiseAND(reads.REVERSE) > 0)


def features(alignments: DataFrame, config: dict | None = None, min_mapq: int = 1) -> DataFrame:
    """Feature columns of an encoder, each with its depth and its chunk's name.

    Contiguous pieces of at least CHUNK columns are cut to overlapping chunks of equal length; shorter ones are one chunk each.
    """
    encoded = encoders.feature_array(encoders.encode(observations(alignments, min_mapq), config or {"type": "counts"}))
    pieces = islands.contiguous(encoded.select("ref_name", "major", "minor", "depth", "features"), ["ref_name"])
    sized = pieces.withColumn("_size", F.count(F.lit(1)).over(W.partitionBy("ref_name", "piece")))
    long = islands.chunks(sized.where(F.col("_size") >= CHUNK), ["ref_name", "piece"], ["major", "minor"], CHUNK, OVERLAP).drop("at")
    short = sized.where(F.col("_size") < CHUNK).withColumn("chunk", F.lit(0).cast("long"))
    both = long.unionByName(short).drop("_size")
    return both.withColumn("sample_id", F.format_string("%s:%010d.%010d", F.col("ref_name"), F.col("piece"), F.col("chunk"))).drop("piece", "chunk")


def inference(alignments: DataFrame, model: Callable[[np.ndarray], np.ndarray] = encoders.majority_model, config: dict | None = None, min_mapq: int = 1) -> DataFrame:
    """ref_name, sample_id, major, minor, depth, probs: class probabilities of every column of every chunk."""
    columns = features(alignments, config, min_mapq)
    packed = columns.groupBy("ref_name", "sample_id").agg(F.array_sort(F.collect_list(F.struct("major", "minor", "depth", "features"))).alias("cells"))
    keep = packed.withColumn("places", F.transform("cells", lambda c: F.struct(c["major"].alias("major"), c["minor"].alias("minor"), c["depth"].alias("depth"))))
    predicted = encoders.predict(packed.withColumn("features", F.transform("cells", lambda c: c["features"])), model, ["ref_name", "sample_id"])
    joined = keep.select("ref_name", "sample_id", "places").join(predicted, ["ref_name", "sample_id"])
    each = joined.select("ref_name", "sample_id", F.explode(F.arrays_zip("places", "probs")).alias("c"))
    return each.select("ref_name", "sample_id", "c.places.major", "c.places.minor", "c.places.depth", "c.probs")


def sequence(columns: DataFrame, draft: DataFrame, fill: str | None = None, min_depth: int | None = None) -> DataFrame:
    """ref_name, seq: stitched consensus with gaps filled from the draft (ref_name, seq) or with ``fill``; contigs without columns are the draft's."""
    return consensus.fill_gaps(consensus.stitch(columns, min_depth), draft, fill)


def with_reference(columns: DataFrame, reference: DataFrame) -> DataFrame:
    """Stitched and decoded columns with ref_symbol, prob and ref_prob."""
    decoded = windows.base_at(consensus.decode(consensus.trim_chunks(columns)), windows.windowed(reference), "ref_name", "major", "_base")
    base = F.when(F.col("minor") == 0, F.upper(F.coalesce("_base", F.lit("")))).otherwise("*")
    rows = decoded.withColumn("ref_symbol", base).withColumn("prob", F.array_max("probs")).drop("_base")
    return rows.withColumn("ref_prob", F.coalesce(F.get("probs", F.instr(F.lit("*ACGT"), F.col("ref_symbol")) - 1), F.lit(0.0)))


def call_variants(columns: DataFrame, reference: DataFrame, ambiguous: bool = False) -> DataFrame:
    """chrom, pos, ref, alt, qual: variants of the consensus, left-aligned; those at an N of the reference only if ``ambiguous``."""
    called = variants.decode(with_reference(columns, reference)).withColumnRenamed("ref_name", "chrom")
    if not ambiguous:
        called = called.where(~F.contains("ref", F.lit("N")))
    return variants.left_align(called, reference.withColumnRenamed("ref_name", "chrom"))


def call_snps(columns: DataFrame, reference: DataFrame, threshold: float = 0.04) -> DataFrame:
    return variants.snp_calls(with_reference(columns, reference), threshold)


def variants_of_consensus(pairs: DataFrame, mode: str = "NW", ambiguous: bool = False, **chunking: int) -> DataFrame:
    """ref_name, pos, ref, alt: variants of a consensus against its reference, from pairs (ref_name, query, seq) of any length; at an N of the reference only if ``ambiguous``.

    Contigs are cut at words both have once and aligned by edits in chained chunks; ``chunking`` goes to ``edit_align.align_long``.
    """
    named = pairs.select(F.col("ref_name").alias("name"), "query", F.col("seq").alias("ref"))
    found = edit_align.align_long(named, mode, with_variants=True, **chunking).select(F.col("name").alias("ref_name"), F.inline("variants"))
    return found if ambiguous else found.where(~F.contains("ref", F.lit("N")))


def coverage_of_consensus(pairs: DataFrame, mode: str = "HW", **chunking: int) -> tuple[DataFrame, DataFrame]:
    """Covered intervals, and gaps, of a consensus on its reference: pairs (ref_name, query, seq)."""
    named = pairs.select(F.col("ref_name").alias("name"), "query", F.col("seq").alias("ref"))
    parts = edit_align.align_long(named, mode, **chunking)
    placed = parts.select(F.col("name").alias("ref_name"), "start", (F.col("start") + S.cigar_length(F.col("cigar"), S.ON_REFERENCE)).cast("long").alias("end"))
    contigs = pairs.select("ref_name", F.length("seq").cast("long").alias("length"))
    return intervals.merge(placed, ["ref_name"]), intervals.complement(placed, contigs, ["ref_name"])


def molecules(subreads: DataFrame, depth: int = 3, length: float = 0) -> DataFrame:
    """read_id, n, seq: consensus of each molecule's sub-reads, all turned to the strand of the longest."""
    good = tandem.deep_molecules(subreads.withColumn("_n", F.length("seq")), ["read_id"], "_n", depth, length)
    longest = subreads.groupBy("read_id").agg(F.max(F.struct(F.length("seq"), "seq")).alias("_t")).select("read_id", F.col("_t.seq").alias("template"))
    turned = align.orient(subreads.join(good.select("read_id"), "read_id", "left_semi").join(longest, "read_id"))
    return poa.molecule_consensus(turned.select("read_id", "seq"), ["read_id"]).join(good.select("read_id", "n"), "read_id")


def region_reads(alignments: DataFrame, regions: DataFrame, min_reads: int = 3, width: int = 1000) -> DataFrame:
    """ref_name, start, end, other columns of the regions, qname, tags, seq, n: what each read that spans a region has there, n its length.

    Regions with few reads or very long ones, and reads of outlying length, are left out. A region has as many reads as its depth.
    """
    keys = [f"_k_{c}" for c in regions.columns]
    spanned = reads.spanning(reads.primary(alignments), regions, width)
    cut = spanned.select(*[F.col(f"a_{c}").alias(c) for c in alignments.columns], *[F.col(f"b_{c}").alias(f"_k_{c}") for c in regions.columns])
    inside = reads.observations(cut).where((F.col("major") >= F.col("_k_start")) & (F.col("major") < F.col("_k_end")) & (F.col("symbol") != "*"))
    parts = F.array_sort(F.collect_list(F.struct("major", "minor", "symbol")))
    allele = inside.groupBy(*keys, "qname").agg(F.first("tags").alias("tags"), F.array_join(F.transform(parts, lambda p: p["symbol"]), "").alias("seq"))
    allele = allele.withColumnsRenamed({k: k[3:] for k in keys}).withColumn("n", F.length("seq"))
    routed = tandem.route_regions(allele, regions.columns, "n", min_reads).where("route = 'ok'").select(*regions.columns)
    return tandem.without_outliers(allele.join(routed, regions.columns, "left_semi"), regions.columns, "n")


def repeats(alignments: DataFrame, regions: DataFrame, reference: DataFrame, min_reads: int = 3, width: int = 1000, clusters: str = "length") -> DataFrame:
    """ref_name, start, end, gt, alt, n1, n2: alleles of each region (ref_name, start, end) from the reads that span it.

    ``clusters``: ``length`` tells two alleles by the widest gap between lengths, ``sequence`` by the columns of a graph of their runs,
    which also tells alleles of equal length.
    """
    if clusters not in ("length", "sequence"):
        raise KeyError(f"clusters {clusters} are not one of length, sequence")
    keys = ["ref_name", "start", "end"]
    kept = region_reads(alignments, regions, min_reads, width)
    clustered = tandem.two_clusters(kept, keys, "n") if clusters == "length" else poa.sequence_clusters(kept, keys)
    called = poa.molecule_consensus(clustered.select(*keys, "cluster", "seq"), [*keys, "cluster"])
    sizes = clustered.groupBy(*keys).agg(F.count_if(F.col("cluster") == 1).alias("n1"), F.count_if(F.col("cluster") == 2).alias("n2"))
    pair = called.groupBy(*keys).agg(F.max(F.when(F.col("cluster") == 1, F.col("seq"))).alias("a1"), F.max(F.when(F.col("cluster") == 2, F.col("seq"))).alias("a2"))
    own = pair.join(reference.select("ref_name", F.col("seq").alias("_seq")), "ref_name")
    ref = F.substr("_seq", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    call = tandem.genotype(ref, F.array(F.col("a1"), F.coalesce("a2", "a1")))
    return own.select(*keys, call["gt"].alias("gt"), call["alt"].alias("alt")).join(sizes, keys)


def compressed_alignments(pairs: DataFrame) -> DataFrame:
    """Pairs (name, query, ref) aligned after homopolymer compression: start in full coordinates, score and CIGAR in runs."""
    squeeze = lambda c: S.compress_homopolymers(F.col(c))["seq"]
    rows = pairs.withColumn("a", align.align(squeeze("query"), squeeze("ref")))
    return rows.select("name", "a.score", F.get(S.run_starts(F.col("ref")), F.col("a.start")).alias("start"), "a.cigar")


def coverage(alignments: DataFrame, contigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Covered intervals, and gaps, of primary alignments on contigs (ref_name, length)."""
    placed = reads.primary(alignments).select("ref_name", F.col("pos").alias("start"), S.reference_end(F.col("pos"), F.col("cigar")).cast("long").alias("end"))
    return intervals.merge(placed, ["ref_name"]), intervals.complement(placed, contigs, ["ref_name"])


def depth_of_records(records: DataFrame, alignments: DataFrame) -> DataFrame:
    """Variant records with the depths of their positions. Only positions of records are piled up."""
    wanted = records.select(F.col("chrom").alias("ref_name"), F.col("pos").alias("major")).distinct()
    seen = observations(alignments).join(wanted, ["ref_name", "major"], "left_semi")
    return variants.annotate_depth(records, pileup.counts(seen))
