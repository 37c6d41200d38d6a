"""Alignments in run space and back, against plain Python over whole strings."""

import itertools
import random
import re

import numpy as np
import pytest

from strandlake.operators import run_space
from strandlake.operators.windows import windowed

READS = "qname string, ref_name string, flag int, pos long, cigar string, seq string"


def runs(text):
    return [(symbol, len(list(group))) for symbol, group in itertools.groupby(text)]


def walk(cigar, read, ref, pos):
    """Bases used of both, and whether = and X say what the bases say."""
    x, y, right = 0, pos, True
    for n, op in ((int(n), op) for n, op in re.findall(r"(\d+)(\D)", cigar)):
        if op in "=X":
            right &= all((read[x + k] == ref[y + k]) == (op == "=") for k in range(n))
        x, y = x + n * (op in "=XIS"), y + n * (op in "=XD")
    return x, y, right


def test_known_alignment(spark):
    contigs = spark.createDataFrame([("c", "TACCCATGTTGATCG")], "ref_name string, seq string")
    reads = spark.createDataFrame([("r", "c", 0, 2, "1S3=1D8=2S", "GCCCAGTTGATCTT"), ("u", "c", 4, 0, None, "ACGT"), ("s", "c", 256, 2, "4=", "CCCA")], READS)
    for width in (4, 5, 100):
        out = run_space.compress_alignments(reads, windowed(contigs, width=width), width).collect()
        assert [(r.qname, r.pos, r.end, r.seq, r.cigar) for r in out] == [("r", 2, 11, "GCAGTGATCT", "1S2=1D6=1S")]


@pytest.mark.parametrize(
    ("cigar", "query", "ref", "want"),
    [
        ("3=", [1, 2, 3], [1, 2, 3], "6="),
        ("1=1=", [3, 1], [1, 4], "1=2I1=3D"),
        ("1S1=1X1S", [2, 1, 3, 5], [2, 2], "2S1=1D2X1I5S"),
        ("1=1I1=1D1=", [1, 2, 2, 1], [1, 1, 3, 1], "1=2I1=1I3D1="),
        ("", [], [], ""),
        ("2D", [], [2, 3], "5D"),
        ("1S", [4], [], "4S"),
    ],
)
def test_expanded(cigar, query, ref, want):
    assert run_space.expanded(cigar, query, ref) == want


@pytest.mark.parametrize("share", [0.02, 0.2, 0.9])
def test_long_reads_in_chunks(share):
    rng = random.Random(5)
    ref = "".join(rng.choice("ACGT") for _ in range(3000))
    read = "".join("" if (x := rng.random()) < share / 2 else rng.choice("ACGT") if x < share else c for c in ref)
    for a, b in ((read, ref), (ref, read), (read, ref[:100]), ("A" * 900, "C" * 700)):
        edits, cigar = run_space.realigned(a, b, 400)
        assert walk(cigar, a, b, 0) == (len(a), len(b), True)
        assert edits == sum(int(n) for n, op in re.findall(r"(\d+)(\D)", cigar) if op != "=")
        fewest = run_space.realigned(a, b)[0]
        assert fewest <= edits
        # Chunks of texts that have little in common have no such bound.
        assert share > 0.5 or edits <= fewest * 1.2 + 20


def test_lengths_that_do_not_fit():
    with pytest.raises(ValueError, match="runs of the read"):
        run_space.expanded("3=", [1, 2], [1, 2, 3])


def test_there_and_back(spark):
    """Noisy reads of two contigs of long runs: the CIGAR uses the whole read and the whole slice, and = and X are true of the bases."""
    rng = random.Random(3)
    contigs = {name: "".join(rng.choice("ACGT") * rng.choice((1, 1, 2, 3, 9)) for _ in range(150)) for name in ("a", "b")}
    contigs["b"] = "A" * 40 + contigs["b"]
    rows = []
    for k in range(60):
        name = rng.choice("ab")
        ref = contigs[name]
        pos = rng.randrange(len(ref) - 40)
        end = rng.randrange(pos + 10, len(ref))
        body = "".join("" if (x := rng.random()) < 0.04 else rng.choice("ACGT") if x < 0.08 else c * 2 if x < 0.12 else c for c in ref[pos:end]) or "A"
        head, tail = "G" * rng.randrange(4), "T" * rng.randrange(4)
        clips = [f"{len(c)}S" if c else "" for c in (head, tail)]
        change = len(body) - (end - pos)
        middle = f"{min(len(body), end - pos)}M" + (f"{change}I" if change > 0 else f"{-change}D" if change < 0 else "")
        rows.append((f"r{k}", name, 16 * (k % 2), pos, clips[0] + middle + clips[1], head + body + tail))
    reads = spark.createDataFrame(rows, READS)
    windows = windowed(spark.createDataFrame(list(contigs.items()), "ref_name string, seq string"), width=16)
    compressed = run_space.compress_alignments(reads, windows, 16).cache()
    given = {r[0]: r for r in rows}
    for r in compressed.collect():
        _, name, _, pos, cigar, seq = given[r.qname]
        spanned = sum(int(n) for n, op in re.findall(r"(\d+)(\D)", cigar) if op in "MD")
        whole = runs(contigs[name])
        assert r.seq == "".join(s for s, _ in runs(seq)) and r.query_runs == [n for _, n in runs(seq)]
        assert r.ref_runs == [n for _, n in runs(contigs[name][pos : pos + spanned])]
        assert r.pos == len(runs(contigs[name][: pos + 1])) - 1 and r.end == r.pos + len(r.ref_runs)
        assert walk(r.cigar, r.seq, "".join(s for s, _ in whole), r.pos) == (len(r.seq), r.end, True)
    back = run_space.expand_alignments(compressed).collect()
    assert len(back) == len(rows)
    for r in back:
        _, name, flag, pos, cigar, seq = given[r.qname]
        spanned = sum(int(n) for n, op in re.findall(r"(\d+)(\D)", cigar) if op in "MD")
        assert (r.flag, r.pos, r.seq) == (flag, pos, seq)
        assert walk(r.cigar, seq, contigs[name], pos) == (len(seq), pos + spanned, True)


def test_empty(spark):
    windows = windowed(spark.createDataFrame([("a", "")], "ref_name string, seq string"))
    reads = spark.createDataFrame([("r", "a", 0, 0, "4M", "ACGT"), ("n", "a", 0, 0, "4S", "ACGT")], READS)
    assert run_space.compress_alignments(reads, windows).count() == 0
    assert run_space.expand_alignments(run_space.compress_alignments(reads.limit(0), windows)).count() == 0


def test_runs_of_a_text():
    for text in ("", "A", "AAB", "ABBBA", "\u00e9\u00e9A"):
        symbols, starts = run_space.runs_of(text)
        runs = [m.group() for m in re.finditer(r"(.)\1*", text)]
        assert symbols == "".join(r[0] for r in runs) and np.diff(starts, append=len(text)).tolist() == [len(r) for r in runs]


def test_reads_are_spread_over_tasks(spark):
    """Little text takes long to align, so its tasks are not merged by their bytes; each text is cut to runs once, not by patterns for each use."""
    reads = spark.createDataFrame([(f"r{k}", "c", 0, 0, "4M", "AACC") for k in range(300)], "qname string, ref_name string, flag int, pos long, cigar string, seq string")
    windows = spark.createDataFrame([("c", 0, "AACCGGTT")], "ref_name string, bin long, window string")
    got = run_space.compress_alignments(reads, windows)
    assert {(r.seq, r.cigar, r.pos, r.end, tuple(r.query_runs)) for r in got.collect()} == {("AC", "2=", 0, 2, (2, 2))}
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
