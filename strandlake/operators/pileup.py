"""Pileups: counts by position, strand and symbol, their depths and normal forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Count columns in the order acgt ACGT d D; rev_ is lower case.
SYMBOLS = ("a", "c", "g", "t")
COUNTS = (*(f"rev_{s}" for s in SYMBOLS), *(f"fwd_{s}" for s in SYMBOLS), "rev_del", "fwd_del")
POSITION = ["ref_name", "major", "minor"]


def _is(strand: str, symbol: str) -> Column:
    wanted = F.lit("*") if symbol == "del" else F.lit(symbol.upper())
    return (F.col("symbol") == wanted) & (F.col("is_rev") == F.lit(strand == "rev"))


def counts(obs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of each code at each position (and ``by``). Observations: ref_name, major, minor, symbol, is_rev. One shuffle, combined map-side.

    Symbols outside ACGT and ``*`` are not counted and do not add to depth; a position with nothing else keeps zeros.
    """
    sums = [F.count_if(_is(*c.split("_"))).alias(c) for c in COUNTS]
    return obs.groupBy(*POSITION, *by).agg(*sums)


def depth(pile: DataFrame, columns: tuple[str, ...] = COUNTS, name: str = "depth") -> DataFrame:
    """The sum of counts at the position's first column, which insertion columns inherit."""
    major = W.partitionBy("ref_name", "major").orderBy("minor")
    total = sum((F.col(c) for c in columns), F.lit(0))
    return pile.withColumn(name, F.first(total).over(major))


def normalise_total(pile: DataFrame) -> DataFrame:
    deep = depth(pile)
    return deep.withColumns({c: F.col(c) / F.greatest(F.lit(1), F.col("depth")) for c in COUNTS})


def normalise_strands(pile: DataFrame) -> DataFrame:
    """Counts over their own strand's depth."""
    for strand in ("rev", "fwd"):
        own = tuple(c for c in COUNTS if c.startswith(strand))
        pile = depth(pile, own, f"{strand}_depth")
        pile = pile.withColumns({c: F.col(c) / F.greatest(F.lit(1), F.col(f"{strand}_depth")) for c in own})
    return pile


def symmetric_indels(pile: DataFrame) -> DataFrame:
    """At insertion columns, reads of a strand without a base count as its deletions."""
    for strand in ("rev", "fwd"):
        own = tuple(c for c in COUNTS if c.startswith(strand))
        here = sum((F.col(c) for c in own), F.lit(0))
        pile = depth(pile, own, "_deep").withColumn(f"{strand}_del", F.when(F.col("minor") > 0, F.col("_deep") - here).otherwise(F.col(f"{strand}_del")))
        pile = pile.drop("_deep")
    return pile


def strata(obs: DataFrame, n: int) -> DataFrame:
    """Counts by quality stratum max(0, min(quality, n) - 1); deletions are in stratum 0."""
    quality = F.when(F.col("symbol") == "*", F.lit(0)).otherwise(F.coalesce("quality", F.lit(0)))
    return counts(obs.withColumn("stratum", F.greatest(F.lit(0), F.least(quality, F.lit(n)) - 1)), ("stratum",))


def weibull_counts(obs: DataFrame, n: int, shape: str = "shape", scale: str = "scale") -> DataFrame:
    """ref_name, major, minor, run_length, weight: partial counts of run lengths 1..n, each observation's mass times 10,000 and truncated."""
    each = obs.withColumn("run_length", F.explode(F.sequence(F.lit(1), F.lit(n))))
    a = F.pow((F.col("run_length") - 1) / F.col(scale), F.col(shape))
    b = F.pow(F.col("run_length") / F.col(scale), F.col(shape))
    mass = F.greatest(F.lit(0.0), -F.exp(-a) * F.expm1(a - b))
    return each.groupBy(*POSITION, "run_length").agg(F.sum(F.floor(F.coalesce(mass, F.lit(0.0)) * 10000)).cast("long").alias("weight"))


def majority_probs(pile: DataFrame) -> DataFrame:
    """probs array<double> in the order *ACGT: strands summed over depth, what is missing goes to the gap."""
    deep = depth(pile)
    d = F.greatest(F.lit(1), F.col("depth"))
    bases = [(F.col(f"rev_{s}") + F.col(f"fwd_{s}")) / d for s in SYMBOLS]
    gap = (F.col("rev_del") + F.col("fwd_del")) / d
    rest = F.greatest(F.lit(0.0), 1 - gap - sum(bases, F.lit(0.0)))
    return deep.withColumn("probs", F.array(gap + rest, *bases))
