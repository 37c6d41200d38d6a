"""Alignments in homopolymer-run space: reads realigned with one symbol a run, and such alignments carried back to bases.

The run that holds a base of a contig is counted over windows: each window knows how many runs began before it, so
neither a row nor a plan carries a contig. Back in base space, a run of the read set against a run of
the reference is as many matches as both have bases, and the surplus is inserted or deleted behind them.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..session import ship, spread
from . import edit_align
from .windows import WIDTH, slices

#: Runs beyond which a read is aligned as a chain of chunks of so many, so that memory follows the chunk.
CHUNK = 20_000
_SYMBOLS = "=XIDSMN"
_ON_READ = np.array([op in S.ON_READ for op in _SYMBOLS])
_ON_REFERENCE = np.array([op in S.ON_REFERENCE for op in _SYMBOLS])


def counted(windows: DataFrame) -> DataFrame:
    """``windows`` (ref_name, bin, window) plus runs_before, the runs that begin in earlier windows, and continues, whether the first base goes on with a run.

    Only a window's first and last base and its number of runs meet in one task for each contig.
    """
    ends = windows.select(
        "ref_name", "bin", F.substr("window", F.lit(1), F.lit(1)).alias("_first"), F.substr("window", F.lit(-1)).alias("_last"), F.size(S.homopolymer_runs(F.col("window"))).cast("long").alias("_runs")
    )
    order = W.partitionBy("ref_name").orderBy("bin")
    joined = ends.withColumn("continues", F.coalesce(F.lag("_last").over(order) == F.col("_first"), F.lit(False)))
    begun = F.sum(F.col("_runs") - F.col("continues").cast("long")).over(order.rowsBetween(W.unboundedPreceding, -1))
    numbered = joined.withColumn("runs_before", F.coalesce(begun, F.lit(0)).cast("long"))
    return windows.join(numbered.select("ref_name", "bin", "runs_before", "continues"), ["ref_name", "bin"])


def run_at(rows: DataFrame, windows: DataFrame, pos: str, into: str, width: int = WIDTH) -> DataFrame:
    """``rows`` with the number, from 0, of the contig's run that holds base ``pos``; null beyond the contig's end. Rows of other contigs go, as in a join.

    ``windows`` as ``counted`` gives them.
    """
    mine = windows.select("ref_name", F.col("bin").alias("_bin"), F.col("window").alias("_window"), F.col("runs_before").alias("_before"), F.col("continues").alias("_continues"))
    at = F.col(pos) % width
    number = F.col("_before") + S.run_of(at, F.col("_window")) - F.col("_continues").cast("long")
    joined = rows.withColumn("_bin", F.floor(F.col(pos) / width)).join(mine, ["ref_name", "_bin"])
    return joined.withColumn(into, F.when(at < F.length("_window"), number)).drop("_bin", "_window", "_before", "_continues")


def run_lengths(seq: Column) -> Column:
    """array<int>: the length of each run."""
    return F.transform(S.homopolymer_runs(seq), lambda run: F.length(run))


def run_symbols(seq: Column) -> Column:
    """The sequence with one symbol a run."""
    return F.array_join(F.transform(S.homopolymer_runs(seq), lambda run: F.substr(run, F.lit(1), F.lit(1))), "")


def runs_of(seq: str) -> tuple[str, np.ndarray]:
    """The sequence with one symbol a run, and where each run begins."""
    x = np.frombuffer(seq.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.flatnonzero(np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]]))
    return x[starts].tobytes().decode("utf-32-le", "surrogatepass"), starts


def realigned(query: str, ref: str, chunk: int = CHUNK) -> tuple[int, str]:
    """Edits and CIGAR from end to end: the fewest, and of sequences longer than ``chunk`` the fewest in each chunk of a chain."""
    if max(len(query), len(ref)) <= chunk:
        edits, _, ops = edit_align.path(query, ref)
        return edits, edit_align.cigar(ops)
    edits, ops, reached = 0, [], None
    for start, end, _, more, part in edit_align.chain(query, ref, chunk=chunk, pad=max(chunk // 10, 1)):
        # A chunk begins with the matches that end the one before.
        shared = 0 if reached is None else reached - start
        ops += [(part[0][0] - shared, part[0][1]), *part[1:]] if part else []
        edits, reached = edits + more, end
    return edits, edit_align.cigar(edit_align.joined(ops))


def compress_alignments(reads: DataFrame, windows: DataFrame, width: int = WIDTH) -> DataFrame:
    """Mapped reads (qname, ref_name, flag, pos, cigar, seq) in run space: qname, ref_name, flag, pos, end, seq, cigar, edits, query_runs, ref_runs, base_pos.

    pos and end count runs of the contig, seq has one symbol a run of the whole read, clips and all, query_runs its run lengths, ref_runs those of the aligned reference,
    from base_pos on. The runs that the alignment touches are aligned anew from end to end (see ``realigned``); other runs are clips. Unmapped (4) and
    secondary (256) reads, and reads without an aligned base, give no row. ``windows``: ref_name, bin, window.
    """
    ship(reads.sparkSession)

    @F.pandas_udf("symbols string, query_runs array<int>, ref_runs array<int>, q0 int, q1 int, edits int, cigar string")
    def realign(queries: pd.Series, firsts: pd.Series, ends: pd.Series, refs: pd.Series) -> pd.DataFrame:
        """Each text is cut to its runs once; the runs of the read from q0 to before q1 are the ones that are aligned."""
        out = []
        for query, first, end, ref in zip(queries, firsts, ends, refs, strict=True):
            (symbols, starts), (ref_symbols, ref_starts) = runs_of(query), runs_of(ref)
            q0, q1 = (int(k) for k in np.searchsorted(starts, [first, end - 1], side="right") - [1, 0])
            out.append((symbols, np.diff(starts, append=len(query)), np.diff(ref_starts, append=len(ref)), q0, q1, *realigned(symbols[q0:q1], ref_symbols)))
        return pd.DataFrame(out, columns=["symbols", "query_runs", "ref_runs", "q0", "q1", "edits", "cigar"])

    clip = lambda pattern: F.coalesce(F.nullif(F.regexp_extract("cigar", pattern, 1), F.lit("")).cast("int"), F.lit(0))
    mapped = reads.where(F.col("flag").bitwiseAND(4 | 256) == 0).select("qname", "ref_name", "flag", F.col("pos").cast("long").alias("base_pos"), "seq", "cigar")
    cut = mapped.withColumns({"_from": clip(r"^(?:\d+H)?(\d+)S"), "_to": F.length("seq") - clip(r"(\d+)S(?:\d+H)?$"), "base_end": S.reference_end(F.col("base_pos"), F.col("cigar"))})
    cut = cut.where((F.col("_to") > F.col("_from")) & (F.col("base_end") > F.col("base_pos")))
    placed = slices(cut, windows, "ref_name", "base_pos", "base_end", "_ref", width).where(F.col("_ref") != "")
    # Little text takes long to align, so its tasks are not merged by their bytes.
    made = spread(placed, "qname", "ref_name", "base_pos").withColumn("_a", realign(F.col("seq"), F.col("_from"), F.col("_to"), F.col("_ref")))
    ends = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("S"))).otherwise("")
    text = F.concat(ends(F.col("_a.q0")), F.col("_a.cigar"), ends(F.length("_a.symbols") - F.col("_a.q1")))
    numbered = run_at(made.withColumn("_cigar", text), counted(windows), "base_pos", "_pos", width)
    return numbered.select(
        "qname",
        "ref_name",
        "flag",
        F.col("_pos").alias("pos"),
        (F.col("_pos") + F.size("_a.ref_runs")).alias("end"),
        F.col("_a.symbols").alias("seq"),
        F.col("_cigar").alias("cigar"),
        F.col("_a.edits").alias("edits"),
        F.col("_a.query_runs").alias("query_runs"),
        F.col("_a.ref_runs").alias("ref_runs"),
        "base_pos",
    )


def expanded(cigar: str, query_runs: np.ndarray, ref_runs: np.ndarray) -> str:
    """The CIGAR over bases of a CIGAR over runs. ``query_runs``: all runs of the read; ``ref_runs``: those from the alignment's start on."""
    pairs = re.findall(r"(\d+)([=XIDSMN])", cigar)
    ops = np.repeat([_SYMBOLS.index(op) for _, op in pairs], [int(n) for n, _ in pairs]).astype(np.int64)
    if not len(ops):
        return ""
    on_read, on_ref = _ON_READ[ops], _ON_REFERENCE[ops]
    if on_read.sum() != len(query_runs) or on_ref.sum() > len(ref_runs):
        raise ValueError(f"{on_read.sum()} runs of the read and {on_ref.sum()} of the reference in the CIGAR, {len(query_runs)} and {len(ref_runs)} in their lengths")
    # The run that an operation takes is the number of those before it that took one.
    read = np.where(on_read, np.asarray(query_runs)[np.minimum(np.cumsum(on_read) - on_read, max(len(query_runs) - 1, 0))] if len(query_runs) else 0, 0)
    ref = np.where(on_ref, np.asarray(ref_runs)[np.minimum(np.cumsum(on_ref) - on_ref, max(len(ref_runs) - 1, 0))] if len(ref_runs) else 0, 0)
    both = on_read & on_ref
    shared = np.where(both, np.minimum(read, ref), read + ref)
    surplus, kind = np.where(both, np.abs(read - ref), 0), np.where(read > ref, _SYMBOLS.index("I"), _SYMBOLS.index("D"))
    sizes, kinds = np.ravel([shared, surplus], "F"), np.ravel([ops, kind], "F")
    sizes, kinds = sizes[sizes > 0], kinds[sizes > 0]
    if not len(sizes):
        return ""
    begins = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]]))
    return "".join(f"{n}{_SYMBOLS[op]}" for n, op in zip(np.add.reduceat(sizes, begins).tolist(), kinds[begins].tolist(), strict=True))


def expand_cigar(cigar: Column, query_runs: Column, ref_runs: Column) -> Column:
    """``expanded`` over columns; null if one is."""

    @F.pandas_udf("string")
    def run(cigars: pd.Series, queries: pd.Series, refs: pd.Series) -> pd.Series:
        return pd.Series([None if c is None or q is None or r is None else expanded(c, q, r) for c, q, r in zip(cigars, queries, refs, strict=True)], dtype=object)

    return run(cigar, query_runs, ref_runs)


def expand_alignments(compressed: DataFrame) -> DataFrame:
    """qname, ref_name, flag, pos, seq, cigar over bases of what ``compress_alignments`` gives."""
    ship(compressed.sparkSession)
    full = F.array_join(F.zip_with(F.split("seq", ""), F.col("query_runs"), lambda symbol, n: F.repeat(symbol, n)), "")
    return compressed.select("qname", "ref_name", "flag", F.col("base_pos").alias("pos"), full.alias("seq"), expand_cigar(F.col("cigar"), F.col("query_runs"), F.col("ref_runs")).alias("cigar"))
