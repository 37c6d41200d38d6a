"""Tandem-repeat genotyping and grouped reads: depth and length filters, outliers, phase sets, ploidy, alleles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .reads import placed_ops


def deep_molecules(subreads: DataFrame, keys: list[str], size: str, depth: int, length: float) -> DataFrame:
    """keys, n, median: groups of at least ``depth`` rows whose median size exceeds ``length``."""
    grouped = subreads.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile(size, F.lit(0.5)).alias("median"))
    return grouped.where((F.col("n") >= depth) & (F.col("median") > length))


def without_outliers(reads: DataFrame, keys: list[str], size: str, multiplier: float = 2.0, above: int = 5) -> DataFrame:
    """Rows within the quartiles plus and minus ``multiplier`` times their range; groups of up to ``above`` rows stay whole."""
    stats = reads.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile(size, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    joined = reads.join(stats, keys)
    reach = (F.col("_q")[1] - F.col("_q")[0]) * multiplier
    inside = (F.col(size) >= F.col("_q")[0] - reach) & (F.col(size) <= F.col("_q")[1] + reach)
    return joined.where((F.col("_n") <= above) | inside).drop("_n", "_q")


def dominant(reads: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows that hold their group's most frequent value; ties go to the smallest."""
    often = reads.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    top = often.groupBy(*keys).agg(F.min(F.struct(-F.col("_n"), F.col(value))).alias("_top")).select(*keys, F.col(f"_top.{value}").alias(value))
    return reads.join(top, [*keys, value], "left_semi")


def length_spread(reads: DataFrame, keys: list[str], size: str) -> DataFrame:
    """keys, n, low, high, median and mad (median absolute deviation)."""
    stats = reads.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(size).alias("low"), F.max(size).alias("high"), F.percentile(size, F.lit(0.5)).alias("median")
    )
    away = reads.join(stats.select(*keys, "median"), keys).withColumn("_away", F.abs(F.col(size) - F.col("median")))
    return stats.join(away.groupBy(*keys).agg(F.percentile("_away", F.lit(0.5)).alias("mad")), keys)


def strand_counts(reads: DataFrame, keys: list[str], haps: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """keys and, for each haplotype, hap*_fwd, hap*_rev and hap*_n; haplotypes without reads have zeros."""
    sums = []
    for h in haps:
        here = F.col("hap") == h
        sums += [F.count_if(here & ~F.col("is_rev")).alias(f"hap{h}_fwd"), F.count_if(here & F.col("is_rev")).alias(f"hap{h}_rev"), F.count_if(here).alias(f"hap{h}_n")]
    return reads.groupBy(*keys).agg(*sums)


def ploidy(ref: Column, sex: Column, in_par: Column, x: tuple[str, ...] = ("chrX", "X"), y: tuple[str, ...] = ("chrY", "Y")) -> Column:
    """2, but 1 on the sex chromosomes of a male outside pseudo-autosomal regions, and 0 on Y of a female."""
    return F.when(ref.isin(*y) & (sex == "female"), 0).when(ref.isin(*x, *y) & (sex == "male") & ~in_par, 1).otherwise(2)


def genotype(ref: Column, alleles: Column) -> Column:
    """struct<gt, alt>: phased genotype of one or two allele sequences (null: not called)."""
    called = F.array_compact(alleles)
    alts = F.array_distinct(F.filter(called, lambda a: a != ref))
    number = lambda a: F.when(a.isNull(), ".").when(a == ref, "0").otherwise(F.array_position(alts, a).cast("string"))
    return F.struct(F.array_join(F.transform(alleles, number), "|").alias("gt"), alts.alias("alt"))


def cluster_table(assigned: DataFrame, keys: list[str]) -> DataFrame:
    """keys, c1h1, c1h2, c2h1, c2h2, flipped: how clusters (1, 2) meet haplotypes (1, 2); flipped if more reads are off the diagonal."""
    cells = [F.count_if((F.col("cluster") == c) & (F.col("hap") == h)).alias(f"c{c}h{h}") for c in (1, 2) for h in (1, 2)]
    return assigned.groupBy(*keys).agg(*cells).withColumn("flipped", F.col("c1h2") + F.col("c2h1") > F.col("c1h1") + F.col("c2h2"))


def route_regions(reads: DataFrame, keys: list[str], size: str, min_reads: int = 3, longest: int = 10_000) -> DataFrame:
    """keys, n, longest, route: ok, few_reads or too_long."""
    stats = reads.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("longest"))
    return stats.withColumn("route", F.when(F.col("n") < min_reads, "few_reads").when(F.col("longest") > longest, "too_long").otherwise("ok"))


def hybrid(primary: DataFrame, fallback: DataFrame, keys: list[str], min_depth: int) -> DataFrame:
    """Rows of ``primary`` in groups whose haplotypes 1 and 2 both have ``min_depth`` reads, else those of ``fallback``."""
    depth = primary.groupBy(*keys).agg(F.least(F.count_if(F.col("hap") == 1), F.count_if(F.col("hap") == 2)).alias("_d"))
    good = depth.where(F.col("_d") >= min_depth).select(*keys)
    return primary.join(good, keys, "left_semi").unionByName(fallback.join(good, keys, "left_anti"))


def two_clusters(reads: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Rows with cluster 1 (shorter) or 2: cut at the widest gap between neighbouring sizes of the group, if each side has three tenths of the rows."""
    w = W.partitionBy(*keys).orderBy(size)
    rows = reads.withColumn("_gap", F.col(size) - F.lag(size).over(w)).withColumn("_at", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    fair = (F.col("_at") >= 0.3 * F.col("_n")) & (F.col("_n") - F.col("_at") >= 0.3 * F.col("_n")) & (F.col("_gap") > 0)
    cut = rows.where(fair).groupBy(*keys).agg(F.max(F.struct("_gap", F.col(size))).alias("_cut"))
    joined = reads.join(cut, keys, "left")
    return joined.withColumn("cluster", F.when(F.col(size) >= F.col(f"_cut.{size}"), 2).otherwise(1)).drop("_cut")


def aligned_bounds(cigar: Column, pos: Column, start: Column, end: Column) -> Column:
    """struct<low, high>: the first and last base of a read that are aligned within the region, its end included; null if none is."""
    held = F.filter(placed_ops(cigar, pos), lambda o: o["op"].isin("M", "=", "X") & (o["ref"] <= end) & (o["ref"] + o["n"] > start))
    first, last = F.get(held, F.lit(0)), F.get(held, F.size(held) - 1)
    low = first["read"] + F.greatest(start - first["ref"], F.lit(0))
    high = last["read"] + F.least(end - last["ref"], last["n"] - 1)
    return F.when(F.size(held) > 0, F.struct(low.cast("long").alias("low"), high.cast("long").alias("high")))


def bounded_allele(seq: Column, bounds: Column) -> Column:
    """The bases from the first bound up to the last, which is left out unless it is the first one too; ``<DEL>`` without bounds."""
    size = F.greatest(bounds["high"] - bounds["low"], F.lit(1)).cast("int")
    return F.when(bounds.isNull(), "<DEL>").otherwise(F.substr(seq, (bounds["low"] + 1).cast("int"), size))


_REGION = ["ref_name", "start", "end"]
_PAIRS = "array<struct<k:string,v:string>>"


def _record(pos: Column, ident: Column, ref: Column, alt: Column, info: Column, genotype: Column) -> list[Column]:
    return [
        F.col("ref_name").alias("chrom"),
        pos.cast("long").alias("pos"),
        ident.alias("id"),
        ref.alias("ref"),
        alt.alias("alt"),
        F.lit(None).cast("double").alias("qual"),
        F.array(F.lit("PASS")).alias("filter"),
        info.cast("map<string,string>").alias("info"),
        genotype.cast(_PAIRS).alias("genotype"),
    ]


def _field(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("k"), value.alias("v"))


def replacement_records(alleles: DataFrame, reads: DataFrame, read_names: bool = False) -> DataFrame:
    """One variant record a region, which replaces its whole reference sequence: alleles (ref_name, start, end, hap, allele, ref, phase_set), reads (ref_name, start, end, hap, qname, length).

    ``hap`` is 1 or 2, or 0 for an allele that stands for both. A haplotype without an allele is not called. GT is phased only if
    all alleles of the region share one phase set that is not 0; PS names it. SD, ALLR and MAD are the depth, the shortest and longest
    read and the median absolute deviation of read lengths, by haplotype. ``read_names`` puts the names of the reads into INFO.
    """
    keys = [*_REGION, "hap"]
    rows = alleles.join(length_spread(reads, keys, "length"), keys, "left")
    if read_names:
        rows = rows.join(reads.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("qname")), ",").alias("names")), keys, "left")
    else:
        rows = rows.withColumn("names", F.lit(None).cast("string"))
    each = F.struct("hap", "allele", F.coalesce("phase_set", F.lit(0)).cast("long").alias("phase_set"), F.coalesce("n", F.lit(0)).alias("n"), "low", "high", "mad", "names")
    found = rows.groupBy(*_REGION).agg(F.max("ref").alias("ref"), F.array_sort(F.collect_list(each)).alias("haps"))
    of = lambda h: F.get(F.filter("haps", lambda x: x["hap"] == h), F.lit(0))["allele"]
    both = F.get("haps", F.lit(0))["hap"] == 0
    call = genotype(F.col("ref"), F.when(both, F.array(of(0), of(0))).otherwise(F.array(of(1), of(2))))
    sets = F.array_distinct(F.transform("haps", lambda x: x["phase_set"]))
    found = found.withColumn("call", call).withColumn("phase", F.when(~both & (F.size(sets) == 1), F.nullif(F.get(sets, F.lit(0)), F.lit(0).cast("long"))))
    joined = lambda f: F.array_join(F.transform("haps", f), ",")
    lengths = lambda x: F.coalesce(F.concat_ws("-", x["low"].cast("long").cast("string"), x["high"].cast("long").cast("string")), F.lit(""))
    fields = F.array(
        _field("GT", F.when(F.col("phase").isNull(), F.replace(F.col("call.gt"), F.lit("|"), F.lit("/"))).otherwise(F.col("call.gt"))),
        _field("SD", joined(lambda x: x["n"].cast("string"))),
        _field("ALLR", joined(lengths)),
        _field("MAD", joined(lambda x: F.when(x["mad"].isNull(), "").otherwise(F.format_string("%.2f", x["mad"].cast("double"))))),
        F.when(F.col("phase").isNotNull(), _field("PS", F.col("phase").cast("string"))),
    )
    named = F.filter("haps", lambda x: x["names"].isNotNull())
    info = F.map_from_arrays(F.transform(named, lambda x: F.concat(F.lit("read_names_hap"), x["hap"].cast("string"))), F.transform(named, lambda x: x["names"]))
    return found.select(*_record(F.col("start"), F.concat_ws("_", *_REGION), F.col("ref"), F.col("call.alt"), info, F.array_compact(fields)))


def decomposed_records(events: DataFrame, reads: DataFrame) -> DataFrame:
    """One record for each event of a haplotype within its region: events (ref_name, start, end, hap, pos, ref, alt), reads as in ``replacement_records``.

    An event is within if the first base it changes is: an insertion or deletion written with the base before it counts from the base
    after that, so one at the very start of a repeat stays. Events of two haplotypes at one position stay two records, told apart by GT (1|0, 0|1; 1|1 for ``hap`` 0) and by the identifier.
    """
    keys = [*_REGION, "hap"]
    changed = F.col("pos") + F.when(F.substr("ref", F.lit(1), F.lit(1)) == F.substr("alt", F.lit(1), F.lit(1)), 1).otherwise(0)
    rows = events.where((changed >= F.col("start")) & (changed < F.col("end")))
    rows = rows.join(reads.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, "left")
    gt = F.when(F.col("hap") == 0, "1|1").when(F.col("hap") == 1, "1|0").otherwise("0|1")
    ident = F.concat(F.concat_ws("_", *_REGION, "pos"), F.lit("_hap"), F.col("hap").cast("string"))
    fields = F.array(_field("GT", gt), _field("SD", F.coalesce("n", F.lit(0)).cast("string")))
    return rows.select(*_record(F.col("pos"), ident, F.col("ref"), F.array("alt"), F.create_map(), fields))


def region_metrics(reads: DataFrame, method: str) -> DataFrame:
    """ref_name, start, end, phasing_method, depth, median and spread of lengths, and reads of each haplotype, of reads as in ``replacement_records``."""
    spread = length_spread(reads, _REGION, "length")
    haps = [F.count_if(F.col("hap") == h).alias(f"hap{h}_reads") for h in (0, 1, 2)]
    counted = reads.groupBy(*_REGION).agg(*haps)
    return spread.join(counted, _REGION).select(*_REGION, F.lit(method).alias("phasing_method"), F.col("n").alias("depth"), F.col("low").alias("shortest"), F.col("high").alias("longest"), "median", "mad", "hap0_reads", "hap1_reads", "hap2_reads")
