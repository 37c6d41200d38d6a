"""Variant records: trimming, splitting, classifying, calling, merging, annotating. Positions are 0-based."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequences import apply_edits, phred
from ..schema import CLASS_SYMBOLS
from . import intervals, islands, windows


def trim(pos: Column, ref: Column, alt: Column) -> Column:
    """struct<pos, ref, alt>: the shared end is taken off first, then the shared start; one base always stays."""
    most = F.least(F.length(ref), F.length(alt)) - 1
    steps = lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(
        steps(most), F.lit(0), lambda k, i: F.when((k == i - 1) & (F.substr(ref, -i, F.lit(1)) == F.substr(alt, -i, F.lit(1))), i).otherwise(k)
    )
    r, a = F.substr(ref, F.lit(1), F.length(ref) - tail), F.substr(alt, F.lit(1), F.length(alt) - tail)
    left = F.least(F.length(r), F.length(a)) - 1
    head = F.aggregate(steps(left), F.lit(0), lambda k, i: F.when((k == i - 1) & (F.substr(r, i, F.lit(1)) == F.substr(a, i, F.lit(1))), i).otherwise(k))
    return F.struct((pos + head).cast("long").alias("pos"), F.substr(r, head + 1, F.length(r)).alias("ref"), F.substr(a, head + 1, F.length(a)).alias("alt"))


def trim_alleles(pos: Column, ref: Column, alts: Column) -> Column:
    """struct<pos, ref, alt>: as ``trim``, for bases that the reference and all of ``alts`` share."""
    shortest = F.array_min(F.transform(F.concat(F.array(ref), alts), F.length))
    steps = lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    same = lambda i: F.forall(alts, lambda a: F.substr(a, i, F.lit(1)) == F.substr(ref, i, F.lit(1)))
    tail = F.aggregate(steps(shortest - 1), F.lit(0), lambda k, i: F.when((k == i - 1) & same(-i), i).otherwise(k))
    head = F.aggregate(steps(shortest - tail - 1), F.lit(0), lambda k, i: F.when((k == i - 1) & same(i), i).otherwise(k))
    rest = lambda a: F.substr(a, head + 1, F.length(a) - tail - head)
    return F.struct((pos + head).cast("long").alias("pos"), rest(ref).alias("ref"), F.transform(alts, rest).alias("alt"))


def classify(ref: Column, alts: Column) -> Column:
    """snp, mnp, sni, mni, snd, mnd, indel or other.

    Lengths that differ make an insertion or a deletion only where all alleles keep the first base of the reference, or all its last.
    """
    n = F.length(ref)
    every = lambda test: F.forall(alts, test)
    change = lambda test: every(lambda a: test(F.length(a) - n))
    anchored = every(lambda a: F.left(a, F.lit(1)) == F.left(ref, F.lit(1))) | every(lambda a: F.right(a, F.lit(1)) == F.right(ref, F.lit(1)))
    return (
        F.when(change(lambda d: d == 0), F.when(n == 1, "snp").otherwise("mnp"))
        .when(~anchored, "other")
        .when(change(lambda d: d > 0), F.when(change(lambda d: d == 1), "sni").otherwise("mni"))
        .when(change(lambda d: d < 0), F.when(change(lambda d: d == -1), "snd").otherwise("mnd"))
        .when(change(lambda d: d != 0), "indel")
        .otherwise("other")
    )


#: Which classes make up each group of record classes.
CLASS_GROUPS = {
    "sub": ("snp", "mnp"),
    "ins": ("sni", "mni"),
    "del": ("snd", "mnd"),
    "indel": ("sni", "mni", "snd", "mnd", "indel"),
    "snid": ("sni", "snd"),
    "mnid": ("mni", "mnd"),
}


def by_class_group(classified: DataFrame, column: str = "kind") -> DataFrame:
    """Each record once for every group it is in, ``all`` included, as class_group."""
    groups = F.concat(*[F.when(F.col(column).isin(*kinds), F.array(F.lit(g))).otherwise(F.array().cast("array<string>")) for g, kinds in CLASS_GROUPS.items()], F.array(F.lit("all")))
    return classified.withColumn("class_group", F.explode(groups))


def split_haplotypes(df: DataFrame) -> DataFrame:
    """One row per non-reference allele of the genotype: haplotype from 1, alt as one string. Needs columns alt (array) and gt."""
    calls = df.select("*", F.posexplode(F.split("gt", r"[/|]")).alias("_h", "_call"))
    calls = calls.withColumn("_n", F.col("_call").try_cast("int")).where(F.col("_n") > 0)
    others = [c for c in df.columns if c not in ("alt", "gt")]
    return calls.select(*others, (F.col("_h") + 1).alias("haplotype"), F.get("alt", F.col("_n") - 1).alias("alt"))


def split_mnp(df: DataFrame) -> DataFrame:
    """Substitutions of several bases as one row per base at which some allele differs, alleles and genotype renumbered."""
    each = df.withColumn("_k", F.explode(F.sequence(F.lit(1), F.length("ref"))))
    base = F.substr("ref", F.col("_k"), F.lit(1))
    alleles = F.concat(F.array(base), F.transform("alt", lambda a: F.substr(a, F.col("_k"), F.lit(1))))
    each = each.withColumn("_all", alleles).withColumn("_distinct", F.array_distinct("_all")).where(F.size("_distinct") > 1)
    calls = F.transform(F.split("gt", r"[/|]"), lambda c: (F.array_position("_distinct", F.get("_all", c.cast("int"))) - 1).cast("string"))
    gt = F.when(F.contains("gt", F.lit("|")), F.array_join(calls, "|")).otherwise(F.array_join(calls, "/"))
    others = [c for c in df.columns if c not in ("pos", "ref", "alt", "gt")]
    return each.select(*others, (F.col("pos") + F.col("_k") - 1).alias("pos"), base.alias("ref"), F.slice("_distinct", 2, 1000).alias("alt"), gt.alias("gt"))


def left_align(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Records (chrom, pos, ref, alt string) shifted as far left as the reference (chrom, seq) allows, then trimmed.

    The shift walks along the reference, so it is a loop; one contig's sequence is joined to its records and never leaves its task.
    """
    def shift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for pos, ref, alt, seq in zip(pdf.pos, pdf.ref, pdf.alt, pdf._seq, strict=True):
                while ref and alt and ref[-1] == alt[-1] and (pos > 0 or min(len(ref), len(alt)) > 1):
                    ref, alt = ref[:-1], alt[:-1]
                    if not ref or not alt:
                        pos -= 1
                        ref, alt = seq[pos] + ref, seq[pos] + alt
                while len(ref) > 1 and len(alt) > 1 and ref[0] == alt[0]:
                    pos, ref, alt = pos + 1, ref[1:], alt[1:]
                out.append((pos, ref, alt))
            done = pd.DataFrame(out, columns=["pos", "ref", "alt"], index=pdf.index)
            yield pdf.drop(columns=["_seq"]).assign(pos=done.pos, ref=done.ref, alt=done.alt)

    joined = df.join(reference.select("chrom", F.col("seq").alias("_seq")), "chrom")
    return joined.mapInPandas(shift, joined.drop("_seq").schema)


def variant_columns(df: DataFrame) -> DataFrame:
    """Adds is_var: at a reference column if the symbols differ, at an insertion column if any column of its position is one."""
    here = W.partitionBy("ref_name", "major")
    differs = F.col("ref_symbol") != F.col("symbol")
    return df.withColumn("is_var", F.when(F.col("minor") == 0, differs).otherwise(F.max(differs).over(here)))


def decode(columns: DataFrame) -> DataFrame:
    """Variants of decoded columns (ref_name, major, minor, ref_symbol, symbol, ref_prob, prob): runs of variant columns.

    Quality is the summed phred of the called classes less that of the reference ones. A run that begins with an insertion takes the
    reference base before it.
    """
    masked = variant_columns(columns)
    w = W.partitionBy("ref_name").orderBy("major", "minor")
    rows = masked.withColumn("_was", F.lag("is_var").over(w)).withColumn("_base", F.when(F.col("minor") == 0, F.col("ref_symbol")))
    rows = rows.withColumn("_before", F.last("_base", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    runs = islands.islands(rows, ["ref_name"], ["major", "minor"], F.col("_was").isNull() | (F.col("_was") != F.col("is_var")), "run").where("is_var")
    parts = F.array_sort(F.collect_list(F.struct("major", "minor", "ref_symbol", "symbol", "_before")))
    grouped = runs.groupBy("ref_name", "run").agg(
        parts.alias("_parts"), F.sum(phred(1 - F.col("prob")) - phred(1 - F.col("ref_prob"))).alias("qual")
    )
    text = lambda field: F.replace(F.array_join(F.transform("_parts", lambda p: p[field]), ""), F.lit("*"), F.lit(""))
    first = F.element_at("_parts", 1)
    lead = (first["minor"] > 0) | (text("ref_symbol") == "") | (text("symbol") == "")
    from_here = lead & (first["minor"] == 0) & (first["major"] == 0)
    base = F.when(lead & ~from_here, F.coalesce(first["_before"], F.lit(""))).otherwise("")
    start = F.when(lead & (first["minor"] == 0) & ~from_here, first["major"] - 1).otherwise(first["major"])
    called = grouped.select("ref_name", start.alias("pos"), F.concat(base, text("ref_symbol")).alias("ref"), F.concat(base, text("symbol")).alias("alt"), "qual")
    return called.where(F.col("ref") != F.col("alt"))


def snp_calls(df: DataFrame, threshold: float = 0.04, symbols: str = CLASS_SYMBOLS) -> DataFrame:
    """Haploid SNPs at reference columns: the two likeliest classes against ``ref_symbol``; gt 0/0, 1/1, 0/1 or 1/2 and qual."""
    from .consensus import top_two

    rows = df.where(F.col("minor") == 0).withColumn("_top", top_two(F.col("probs")))
    sym = lambda k: F.substr(F.lit(symbols), F.get("_top", F.lit(k)) + 1, F.lit(1))
    p = lambda k: F.get("probs", F.get("_top", F.lit(k)))
    rows = rows.select("*", sym(0).alias("_s1"), sym(1).alias("_s2"), p(0).alias("_p1"), p(1).alias("_p2"))
    second = (F.col("_p2") >= threshold) & (F.col("_s2") != "*")
    is_ref1, is_ref2 = F.col("_s1") == F.col("ref_symbol"), F.col("_s2") == F.col("ref_symbol")
    gt = (
        F.when(~second, F.when(is_ref1, "0/0").otherwise("1/1"))
        .when(is_ref1 | is_ref2, "0/1")
        .otherwise("1/2")
    )
    alts = F.when(~second, F.when(is_ref1, F.array().cast("array<string>")).otherwise(F.array("_s1")))
    alts = alts.when(is_ref1, F.array("_s2")).when(is_ref2, F.array("_s1")).otherwise(F.array("_s1", "_s2"))
    error = F.when(second, 1 - F.col("_p1") - F.col("_p2")).otherwise(1 - F.col("_p1"))
    return rows.where(F.col("_s1") != "*").select("ref_name", F.col("major").alias("pos"), F.col("ref_symbol").alias("ref"), alts.alias("alt"), gt.alias("gt"), phred(error).alias("qual"))


def merge_haplotypes(hap1: DataFrame, hap2: DataFrame, reference: DataFrame) -> DataFrame:
    """Two haploid call sets (chrom, pos, ref, alt, qual) as one diploid: overlapping or touching calls become one record.

    Each haplotype's calls are applied to the reference stretch they span; gt is 1|1, 1|2, 1|0 or 0|1; stretches that both leave as they are go.
    qual is the mean over haplotypes of their calls' mean, without a haplotype whose calls leave the stretch as it is. Records are trimmed.
    A call whose ref is not the reference's is an error.
    """
    both = hap1.withColumn("hap", F.lit(1)).unionByName(hap2.withColumn("hap", F.lit(2)))
    spans = both.withColumn("start", F.col("pos")).withColumn("end", F.col("pos") + F.length("ref"))
    numbered = intervals.with_islands(spans, ["chrom"])
    edits = lambda h: F.array_sort(F.collect_list(F.when(F.col("hap") == h, F.struct("pos", "ref", "alt"))))
    grouped = numbered.groupBy("chrom", "island").agg(
        F.min("start").alias("pos"),
        F.max("end").alias("_end"),
        edits(1).alias("_e1"),
        edits(2).alias("_e2"),
        F.avg(F.when(F.col("hap") == 1, F.coalesce("qual", F.lit(0.0)))).alias("_q1"),
        F.avg(F.when(F.col("hap") == 2, F.coalesce("qual", F.lit(0.0)))).alias("_q2"),
    )
    grouped = grouped.join(reference.select("chrom", F.col("seq").alias("_seq")), "chrom")
    grouped = grouped.withColumn("ref", F.substr("_seq", (F.col("pos") + 1).cast("int"), (F.col("_end") - F.col("pos")).cast("int")))
    local = lambda e: F.transform(e, lambda x: F.struct((x["pos"] - F.col("pos")).alias("pos"), x["ref"].alias("ref"), x["alt"].alias("alt")))
    agrees = lambda e: F.forall(local(e), lambda x: F.substr(F.col("ref"), x["pos"].cast("int") + 1, F.length(x["ref"])) == x["ref"])
    wrong = F.raise_error(F.concat(F.lit("reference differs from a call in "), F.col("chrom"), F.lit(":"), F.col("pos").cast("string"))).cast("string")
    applied = lambda e: F.when(agrees(e), apply_edits(F.col("ref"), local(e))).otherwise(wrong)
    grouped = grouped.withColumn("_a1", applied("_e1")).withColumn("_a2", applied("_e2"))
    same1, same2 = F.col("_a1") == F.col("ref"), F.col("_a2") == F.col("ref")
    gt = F.when(same2, "1|0").when(same1, "0|1").when(F.col("_a1") == F.col("_a2"), "1|1").otherwise("1|2")
    alts = F.when(same2, F.array("_a1")).when(same1, F.array("_a2")).otherwise(F.array_distinct(F.array("_a1", "_a2")))
    quals = F.array_compact(F.array(F.when(~same1, F.col("_q1")), F.when(~same2, F.col("_q2"))))
    mean = F.aggregate(quals, F.lit(0.0), lambda t, q: t + q) / F.size(quals)
    merged = grouped.where(~(same1 & same2)).select("chrom", trim_alleles(F.col("pos"), F.col("ref"), alts).alias("_t"), gt.alias("gt"), mean.alias("qual"))
    return merged.select("chrom", "_t.pos", "_t.ref", "_t.alt", "gt", "qual")


def homozygous_gaps(df: DataFrame, least: int = 1000) -> DataFrame:
    """chrom, start, end: stretches between neighbouring heterozygous positions (chrom, pos) at least ``least`` long."""
    w = W.partitionBy("chrom").orderBy("pos")
    gaps = df.select("chrom", "pos").distinct().withColumn("end", F.lead("pos").over(w))
    return gaps.where(F.col("end") - F.col("pos") >= least).select("chrom", F.col("pos").alias("start"), "end")


def zygosity_regions(mixed: DataFrame, regions: DataFrame, least: int = 1000, width: int = 100_000) -> DataFrame:
    """chrom, region_start, region_end, kind, start, end: each region (chrom, start, end) in homozygous and heterozygous stretches.

    ``mixed`` holds the heterozygous records (chrom, pos, ref); each takes all bases of its ref. A homozygous stretch leads from a
    region's start or a base so taken to the next one or the region's end, ``least`` (two or more) bases or longer. A heterozygous
    one is what lies between homozygous ones, if longer than ``least``. Records may overlap one another or a region's ends.
    """
    spans = mixed.select("chrom", F.col("pos").alias("start"), (F.col("pos") + F.length("ref")).alias("end"))
    wanted = regions.select("chrom", "start", "end").distinct()
    key = ["chrom", "region_start", "region_end"]
    hits = intervals.overlap_join(wanted, spans, ["chrom"], width)
    taken = hits.select(F.col("a_chrom").alias("chrom"), F.col("a_start").alias("region_start"), F.col("a_end").alias("region_end"), F.col("b_start").alias("first"), (F.col("b_end") - 1).alias("last"))
    bounds = wanted.select("chrom", F.col("start").alias("region_start"), F.col("end").alias("region_end"), F.explode(F.array("start", "end")).alias("first"))
    before = W.partitionBy(*key).orderBy("first", "last").rowsBetween(W.unboundedPreceding, -1)
    gaps = taken.unionByName(bounds.withColumn("last", F.col("first"))).withColumn("from", F.max("last").over(before))
    same = gaps.where(F.col("first") - F.col("from") >= least).select(*key, F.col("from").alias("start"), F.col("first").alias("end"))
    last = wanted.select("chrom", F.col("start").alias("region_start"), F.col("end").alias("region_end"), F.col("end").alias("start"), F.lit(None).cast("long").alias("end"))
    left = F.coalesce(F.lag("end").over(W.partitionBy(*key).orderBy("start")), F.col("region_start"))
    other = same.unionByName(last).withColumn("left", left).where(F.col("start") - F.col("left") > least)
    other = other.select(*key, F.lit("heterozygous").alias("kind"), F.col("left").alias("start"), F.col("start").alias("end"))
    return same.select(*key, F.lit("homozygous").alias("kind"), "start", "end").unionByName(other)


def padded_haplotypes(df: DataFrame, reference: DataFrame, pad: int) -> DataFrame:
    """Each record with haps: the reference and each allele within ``pad`` bases on both sides; a ref that is not the reference's is an error."""
    spans = df.withColumn("_from", F.greatest(F.lit(0), F.col("pos") - pad).cast("long")).withColumn("_to", (F.col("pos") + F.length("ref") + pad).cast("long"))
    # Contigs that the reference lacks have no haplotypes.
    known = spans.join(reference.select("chrom").distinct(), "chrom", "left_semi")
    joined = windows.slices(known, windows.windowed(reference, "chrom"), "chrom", "_from", "_to", "_around")
    before = (F.col("pos") - F.col("_from")).cast("int")
    there = F.substr("_around", before + 1, F.length("ref"))
    left = F.substr("_around", F.lit(1), before)
    right = F.substr("_around", before + F.length("ref") + 1)
    wrap = lambda a: F.concat(left, a, right)
    haps = F.when(there == F.col("ref"), F.concat(F.array(wrap(F.col("ref"))), F.transform("alt", wrap))).otherwise(
        F.raise_error(F.concat(F.lit("reference differs at "), F.col("chrom"), F.lit(":"), F.col("pos").cast("string"))).cast("array<string>")
    )
    return joined.withColumn("haps", haps).drop("_from", "_to", "_around")


def annotate_depth(df: DataFrame, pile: DataFrame) -> DataFrame:
    """Records (chrom, pos, ...) with dp, dp_fwd and dp_rev of their position; 0 where nothing is piled up."""
    own = lambda s: sum((F.col(f"{s}_{x}") for x in ("a", "c", "g", "t", "del")), F.lit(0))
    at = pile.where(F.col("minor") == 0).select(F.col("ref_name").alias("chrom"), F.col("major").alias("pos"), own("fwd").alias("dp_fwd"), own("rev").alias("dp_rev"))
    joined = df.join(at, ["chrom", "pos"], "left")
    filled = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("dp_fwd", "dp_rev")}
    return joined.withColumns(filled).withColumn("dp", F.col("dp_fwd") + F.col("dp_rev"))


def genotype_alleles(ref: Column, alts: Column, gt: Column) -> Column:
    """struct<phased, alleles>: the sequences that a genotype names, null where it is ``.``."""
    every = F.concat(F.array(ref), alts)
    return F.struct(F.contains(gt, F.lit("|")).alias("phased"), F.transform(F.split(gt, r"[/|]"), lambda c: F.get(every, c.try_cast("int"))).alias("alleles"))


def diploid_calls(df: DataFrame, classes: list[str]) -> DataFrame:
    """SNPs at reference columns from probabilities of unordered symbol pairs: gt and qual of the likeliest pair, records with a gap left out."""
    from .consensus import argmax

    best = argmax(F.col("probs"))
    rows = df.where(F.col("minor") == 0).withColumn("_pair", F.get(F.array(*map(F.lit, classes)), best)).where(~F.contains("_pair", F.lit("*")))
    sym = lambda k: F.substr("_pair", F.lit(k), F.lit(1))
    ref = F.col("ref_symbol")
    alts = F.array_distinct(F.filter(F.array(sym(1), sym(2)), lambda a: a != ref))
    hets = F.when(F.size(alts) == 0, "0/0").when(F.size(alts) == 2, "1/2").when((sym(1) == ref) | (sym(2) == ref), "0/1").otherwise("1/1")
    return rows.select("ref_name", F.col("major").alias("pos"), ref.alias("ref"), alts.alias("alt"), hets.alias("gt"), phred(1 - F.array_max("probs")).alias("qual"))


def from_observations(obs: DataFrame, reference: DataFrame) -> DataFrame:
    """Variants of aligned reads against the reference (ref_name, seq): runs of differing columns with the matching base before them, by read."""
    joined = windows.base_at(obs, windows.windowed(reference), "ref_name", "major", "_base")
    base = F.when(F.col("minor") == 0, F.coalesce("_base", F.lit(""))).otherwise("*")
    rows = joined.withColumn("ref_symbol", F.upper(base)).drop("_base").withColumn("_differs", F.col("symbol") != F.col("ref_symbol"))
    w = W.partitionBy("ref_name", "qname").orderBy("major", "minor")
    rows = rows.withColumn("_was", F.lag("_differs").over(w)).withColumn("_before", F.lag(F.struct("major", "ref_symbol")).over(w))
    runs = islands.islands(rows, ["ref_name", "qname"], ["major", "minor"], F.col("_was").isNull() | (F.col("_was") != F.col("_differs")), "run").where("_differs")
    parts = F.array_sort(F.collect_list(F.struct("major", "minor", "ref_symbol", "symbol", "_before")))
    grouped = runs.groupBy("ref_name", "qname", "run").agg(parts.alias("_p"))
    text = lambda f: F.replace(F.array_join(F.transform("_p", lambda p: p[f]), ""), F.lit("*"), F.lit(""))
    before = F.element_at("_p", 1)["_before"]
    first = F.element_at("_p", 1)
    lead = (F.length(text("ref_symbol")) != F.length(text("symbol"))) & before.isNotNull()
    return grouped.select(
        "ref_name",
        "qname",
        F.when(lead, before["major"]).otherwise(first["major"]).alias("pos"),
        F.concat(F.when(lead, before["ref_symbol"]).otherwise(""), text("ref_symbol")).alias("ref"),
        F.concat(F.when(lead, before["ref_symbol"]).otherwise(""), text("symbol")).alias("alt"),
    )


def at_known_loci(df: DataFrame, loci: DataFrame) -> DataFrame:
    """Records at (chrom, pos) of ``loci``."""
    return df.join(loci.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_semi")


def info_table(df: DataFrame, keys: list[str]) -> DataFrame:
    """Records as plain columns: one per INFO key, null where a record lacks it."""
    return df.select("chrom", (F.col("pos") + 1).alias("pos"), "id", "ref", F.array_join("alt", ",").alias("alt"), "qual", F.array_join("filter", ";").alias("filter"), *[F.col("info")[k].alias(k) for k in keys])
