"""From class probabilities to symbols, qualities, sequences and stitched chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequences import phred, phred_char
from ..schema import CLASS_SYMBOLS
from ..session import spread
from . import intervals, islands


def argmax(probs: Column) -> Column:
    """The first index, from 0, of the largest value."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def top_two(probs: Column) -> Column:
    """array<int>: indexes of the two largest values; of equal ones the later comes first."""
    pairs = F.transform(probs, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    return F.transform(F.slice(F.sort_array(pairs, asc=False), 1, 2), lambda s: s["i"])


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda t, x: t + x)
    return F.transform(powers, lambda x: x / total)


def call(probs: Column, symbols: str = CLASS_SYMBOLS, cap: float = 70.0) -> tuple[Column, Column]:
    """Symbol of the likeliest class, and phred of the remaining probability."""
    return F.substr(F.lit(symbols), argmax(probs) + 1, F.lit(1)), phred(1 - F.array_max(probs), cap)


def decode(df: DataFrame, symbols: str = CLASS_SYMBOLS, cap: float = 70.0) -> DataFrame:
    """symbol, quality (phred of the remaining probability) and its character."""
    symbol, quality = call(F.col("probs"), symbols, cap)
    return df.withColumn("symbol", symbol).withColumn("quality", quality).withColumn("qual_char", phred_char(quality))


def sequences(decoded: DataFrame, keys: list[str], gaps: bool = False) -> DataFrame:
    """keys, seq, qual: symbols in order of position, gaps left out."""
    rows = decoded if gaps else decoded.where(F.col("symbol") != "*")
    parts = F.array_sort(F.collect_list(F.struct("major", "minor", "symbol", "qual_char")))
    grouped = rows.groupBy(*keys).agg(parts.alias("_parts"))
    text = lambda field: F.array_join(F.transform("_parts", lambda p: p[field]), "")
    return grouped.select(*keys, text("symbol").alias("seq"), text("qual_char").alias("qual"))


def run_length_sequences(df: DataFrame, keys: list[str], base: str, run: str) -> DataFrame:
    """keys, seq: each base repeated as often as its run is long."""
    parts = F.array_sort(F.collect_list(F.struct("major", "minor", F.repeat(F.col(base), F.col(run)).alias("text"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("seq"))


def relationship(a: Column, b: Column) -> Column:
    """How chunk ``b`` stands to chunk ``a``: structs of ref_name, first and last (structs of major, minor) and size."""
    swap = (b["first"] < a["first"]) | ((b["first"] == a["first"]) & (b["size"] > a["size"]))

    def told(one: Column, two: Column, way: str, inside: str) -> Column:
        m1, n1, m2, n2 = one["last"]["major"], one["last"]["minor"], two["first"]["major"], two["first"]["minor"]
        abuts = ((m2 == m1 + 1) & (n2 == 0)) | ((m2 == m1) & (n2 == n1 + 1))
        meets = (m2 < m1) | ((m2 == m1) & (n2 < n1 + 1))
        return (
            F.when(two["last"] <= one["last"], inside).when(abuts, f"{way}_abutted").when(meets, f"{way}_overlap").otherwise(f"{way}_gapped")
        )

    return (
        F.when(a["ref_name"] != b["ref_name"], "different_ref_name")
        .when(swap, told(b, a, "reverse", "s1_within_s2"))
        .otherwise(told(a, b, "forward", "s2_within_s1"))
    )


def positions_packed(columns: DataFrame, *fields: str) -> DataFrame:
    """ref_name, sample_id, cells: the columns of each chunk as one sorted array of structs of major, minor and ``fields``. A chunk has some thousand columns."""
    return columns.groupBy("ref_name", "sample_id").agg(F.array_sort(F.collect_list(F.struct("major", "minor", *fields))).alias("cells"))


def with_runs(samples: DataFrame, cells: str = "cells", into: str = "runs") -> DataFrame:
    """``samples`` with the positions of sorted ``cells`` as runs: array<struct<major, minor, n>>, n columns of one minor whose major goes up by one each."""
    at = lambda i: F.get(cells, i)
    goes_on = lambda i: (at(i)["major"] == at(i - 1)["major"] + 1) & (at(i)["minor"] == at(i - 1)["minor"])
    none = F.array().cast("array<int>")
    begins = F.when(F.size(cells) > 0, F.filter(F.sequence(F.lit(0), F.size(cells) - 1), lambda i: (i == 0) | ~goes_on(i))).otherwise(none)
    rows = samples.withColumn("_begins", begins)
    ends = F.concat(F.slice("_begins", F.lit(2), F.size("_begins")), F.when(F.size(cells) > 0, F.array(F.size(cells))).otherwise(none))
    run = lambda i, end: F.struct(at(i)["major"].alias("major"), at(i)["minor"].alias("minor"), (end - i).cast("long").alias("n"))
    return rows.withColumn(into, F.zip_with("_begins", ends, run)).drop("_begins")


def _kept(run: Column, low: Column, high: Column, inclusive: bool) -> tuple[Column, Column]:
    """First and last place within a run of what lies from ``low`` to ``high`` (structs of major, minor; null: open); none if the last is less than the first."""
    after = F.greatest(F.lit(0), low["major"] - run["major"] + (run["minor"] < low["minor"]).cast("long"))
    beyond = run["minor"] > high["minor"] if inclusive else run["minor"] >= high["minor"]
    return after, F.least(run["n"] - 1, high["major"] - run["major"] - beyond.cast("long"))


def clip_runs(runs: Column, low: Column, high: Column, inclusive: bool = False) -> Column:
    """Runs cut to the positions from ``low`` to before ``high``, or to ``high`` if ``inclusive``. Equal positions give equal runs."""

    def cut(run: Column) -> Column:
        first, last = _kept(run, low, high, inclusive)
        return F.struct((run["major"] + first).alias("major"), run["minor"].alias("minor"), (last - first + 1).alias("n"))

    return F.filter(F.transform(runs, cut), lambda run: run["n"] > 0)


def _nth(runs: Column, place: Column) -> Column:
    """struct<major, minor>: the position at ``place``, from 0."""
    nothing = F.lit(None).cast("struct<major: bigint, minor: bigint>")
    found = F.aggregate(
        runs,
        F.struct(place.alias("left"), nothing.alias("at")),
        lambda s, run: F.struct(
            (s["left"] - run["n"]).alias("left"),
            F.when((s["left"] >= 0) & (s["left"] < run["n"]), F.struct((run["major"] + s["left"]).alias("major"), run["minor"].cast("long").alias("minor"))).otherwise(s["at"]).alias("at"),
        ),
    )
    return found["at"]


def _total(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda total, run: total + run["n"])


def _last(runs: str) -> Column:
    """struct<major, minor>: the last position."""
    end = F.get(runs, F.size(runs) - 1)
    return F.struct((end["major"] + end["n"] - 1).alias("major"), end["minor"].alias("minor"))


def _even_cut(one: Column, two: Column) -> Column:
    """struct<major, minor>: where to cut chunks whose shared stretch has different columns, given as runs."""
    count = lambda runs, major: F.size(F.filter(runs, lambda run: (run["major"] <= major) & (major < run["major"] + run["n"])))
    majors = F.array_distinct(F.flatten(F.transform(F.concat(one, two), lambda run: F.sequence(run["major"], run["major"] + run["n"] - 1))))
    middle = F.floor((F.array_min(majors) + F.array_max(majors)) / 2)
    usable = F.when(F.size(majors) > 3, F.filter(majors, lambda m: (m != middle) & (count(one, m) == count(two, m))))
    best = F.array_min(F.transform(usable, lambda m: F.struct(F.abs(m - middle).alias("far"), (-m).alias("late"), m.alias("major"))))
    return F.struct(F.coalesce(best["major"], middle).alias("major"), F.lit(0).cast("long").alias("minor"))


def trim_samples(samples: DataFrame) -> DataFrame:
    """Chunks (ref_name, sample_id, runs, ...; see ``with_runs``) that are not within what went before, with piece, start and stop.

    Of its columns a chunk keeps those from start to before stop (structs of major and minor, null where nothing is cut off); the rules are those of ``trim_chunks``.
    A chunk is one row and its positions a few runs, so contigs are put in order without their columns. Deal ``samples`` by ref_name with ``spread``:
    rows of runs shrink so much when shuffled that adaptive execution, which goes by bytes, would give a task more of them than it can sort in memory.
    """
    # Every column is held once for each row while contigs are put in order; what a window gives of other chunks is worked out from their runs afterwards.
    order = W.partitionBy("ref_name").orderBy("_major", "_minor", F.desc("_size"), "sample_id")
    reach = F.max("_last").over(order.rowsBetween(W.unboundedPreceding, -1))
    # Chunks without columns go after the window: a condition on runs before it would be pushed into what makes them, and cells made anew for each place.
    first = F.get("runs", F.lit(0))
    meta = samples.withColumns({"_major": first["major"], "_minor": first["minor"], "_last": _last("runs"), "_size": _total(F.col("runs"))})
    meta = meta.withColumn("_reach", reach).where((F.col("_size") > 0) & (F.col("_reach").isNull() | (F.col("_last") > F.col("_reach")))).drop("_reach", "_size", "_last")
    order = W.partitionBy("ref_name").orderBy("_major", "_minor", "sample_id")
    meta = meta.withColumn("_next", F.lead("runs").over(order)).withColumn("_prev", F.lag("runs").over(order))
    begin, after = (F.struct(F.get(c, F.lit(0))["major"].alias("major"), F.get(c, F.lit(0))["minor"].alias("minor")) for c in ("runs", "_next"))
    prev, last = F.when(F.col("_prev").isNotNull(), _last("_prev")), _last("runs")
    gap = prev.isNull() | ~(
        (begin <= prev) | ((begin["major"] == prev["major"] + 1) & (begin["minor"] == 0)) | ((begin["major"] == prev["major"]) & (begin["minor"] == prev["minor"] + 1))
    )
    meta = islands.islands(meta.withColumn("_gap", gap), ["ref_name"], ["_major", "_minor", "sample_id"], F.col("_gap"), "piece").drop("_gap", "_prev")
    # What a chunk and the next one have where they overlap, side by side.
    shared = lambda runs: F.when(F.col("_next").isNotNull() & (after <= last), clip_runs(runs, after, last, inclusive=True))
    meta = meta.withColumns({"_one": shared(F.col("runs")), "_two": shared(F.col("_next"))})
    middle = _nth(F.col("_one"), F.floor(_total(F.col("_one")) / 2))
    cut = F.when(F.col("_one").isNotNull(), F.when(F.col("_one") == F.col("_two"), middle).otherwise(_even_cut(F.col("_one"), F.col("_two"))))
    meta = meta.withColumn("stop", cut).withColumn("start", F.lag("stop").over(order))
    return meta.drop("_major", "_minor", "_next", "_one", "_two")


def trim_chunks(columns: DataFrame) -> DataFrame:
    """Columns of overlapping chunks (ref_name, sample_id, major, minor, ...) cut so that each position is in one chunk; adds piece, which a gap ends.

    A chunk within what went before is dropped. Two overlapping chunks with the same columns where they overlap are cut in the
    middle; with different ones, at the major position nearest the middle at which both have equally many columns, or, if
    there is none, the later chunk takes over from the middle.
    """
    bounds = trim_samples(spread(with_runs(positions_packed(columns)).drop("cells"), "ref_name")).drop("runs")
    here = F.struct("major", "minor")
    kept = columns.join(bounds, ["ref_name", "sample_id"])
    kept = kept.where((F.col("start").isNull() | (here >= F.col("start"))) & (F.col("stop").isNull() | (here < F.col("stop"))))
    return kept.drop("start", "stop")


def stitch(columns: DataFrame, min_depth: int | None = None, symbols: str = CLASS_SYMBOLS) -> DataFrame:
    """ref_name, start, stop (inclusive), seq, qual: one row per stitched piece of chunks with class probabilities."""
    decoded = decode(columns, symbols)
    deep = F.lit(True) if min_depth is None else F.coalesce(F.col("depth") >= min_depth, F.lit(False))
    return stitch_samples(positions_packed(decoded.withColumn("deep", deep), "symbol", "qual_char", "deep"), filtered=min_depth is not None)


def stitch_samples(samples: DataFrame, filtered: bool = False) -> DataFrame:
    """``stitch`` for chunks as rows: ref_name, sample_id, cells, a sorted array of structs of major, minor, symbol and qual_char; ``filtered``: and deep, which is false for columns to leave out.

    Chunks go to their contig with a character a column for symbols and one for qualities, once.
    """
    rows = with_runs(samples)
    if filtered:
        rows = with_runs(rows.withColumn("cells", F.filter("cells", lambda c: c["deep"])), into="own")
    else:
        rows = rows.withColumn("own", F.col("runs"))
    # A gap's quality is a space, so that both texts have the same places.
    text = lambda of: F.array_join(F.transform("cells", of), "")
    quality = lambda c: F.when(c["symbol"] == "*", " ").otherwise(c["qual_char"])
    rows = rows.withColumns({"symbols": text(lambda c: c["symbol"]), "quals": text(quality)}).drop("cells")
    trimmed = trim_samples(spread(rows, "ref_name"))
    first = F.transform("own", lambda run, i: F.struct(run.alias("run"), _total(F.slice("own", F.lit(1), i)).alias("at")))

    def part(x: Column) -> Column:
        low, high = _kept(x["run"], F.col("start"), F.col("stop"), inclusive=False)
        return F.struct((x["run"]["major"] + low).alias("major"), x["run"]["minor"].alias("minor"), (x["run"]["major"] + high).alias("stop"), (x["at"] + low + 1).cast("int").alias("at"), (high - low + 1).cast("int").alias("n"))

    parts = trimmed.withColumn("_part", F.explode(F.filter(F.transform(first, part), lambda p: p["n"] > 0)))
    cut = lambda c: F.substr(c, F.col("_part.at"), F.col("_part.n"))
    parts = parts.select("ref_name", "_part.major", "_part.minor", "_part.stop", cut("symbols").alias("seq"), cut("quals").alias("qual"))
    before = F.lag("stop").over(W.partitionBy("ref_name").orderBy("major", "minor"))
    pieces = islands.islands(parts.withColumn("_gap", F.col("major") - before > 1), ["ref_name"], ["major", "minor"], F.col("_gap"), "piece")
    whole = lambda c, gap: F.replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("major", "minor", c))), lambda p: p[c]), ""), F.lit(gap), F.lit(""))
    joined = pieces.groupBy("ref_name", "piece").agg(F.min("major").alias("start"), F.max("stop").alias("stop"), whole("seq", "*").alias("seq"), whole("qual", " ").alias("qual"))
    return joined.select("ref_name", "start", "stop", F.nullif("seq", F.lit("")).alias("seq"), F.nullif("qual", F.lit("")).alias("qual"))


def fill_gaps(pieces: DataFrame, draft: DataFrame, fill: str | None = None) -> DataFrame:
    """ref_name, seq: stitched pieces (inclusive stop) in place, gaps filled from ``draft`` (ref_name, seq) or with ``fill``; contigs without pieces are the draft's."""
    lengths = draft.select("ref_name", F.length("seq").cast("long").alias("length"))
    covered = pieces.select("ref_name", "start", (F.col("stop") + 1).alias("end"))
    gaps = intervals.complement(covered, lengths, ["ref_name"]).join(draft.withColumnRenamed("seq", "_draft"), "ref_name")
    cut = F.substr("_draft", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    text = cut if fill is None else F.repeat(F.lit(fill), (F.col("end") - F.col("start")).cast("int"))
    parts = gaps.select("ref_name", "start", text.alias("seq")).unionByName(pieces.select("ref_name", "start", "seq"))
    return parts.groupBy("ref_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "seq"))), lambda p: p["seq"]), "").alias("seq"))
