"""Polishing: reads are aligned to their draft, piled up, decoded and stitched, again and again until the draft stays as it is."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import edit_align, encoders
from ..schema import CLASS_SYMBOLS
from ..session import cut_lineage, ship, spread
from . import pipelines

#: Counts with deletions at inserted columns too, so that a base most reads lack is not inserted.
SYMMETRIC = {"type": "counts", "kwargs": {"symmetric": True}}
#: The longest draft whose columns are put together in one task; those of longer ones are rows.
WHOLE = 65_536
#: Columns that a model gets at a time.
COLUMNS = 1 << 20
#: Places in ``pileup.COUNTS`` of a read's bases, as all reads are turned to their draft; the last is of symbols that are not counted.
CODES = np.full(256, 10, np.int64)
CODES[np.frombuffer(b"ACGTacgt*", np.uint8)] = [4, 5, 6, 7, 4, 5, 6, 7, 9]


def aligned_reads(drafts: DataFrame, subreads: DataFrame, mode: str = "NW", **chunking: int) -> DataFrame:
    """Alignments of reads (name, read, seq) to the draft of their name (name, seq), which is their reference.

    A long read is several alignments. Neighbours share a match; the later one is given without it, so no base is seen twice.
    """
    pair = F.to_json(F.struct("name", "read"))
    pairs = subreads.where("seq is not null and name is not null").join(drafts.select("name", F.col("seq").alias("_draft")), "name").select(pair.alias("pair"), "name", "seq", "_draft")
    found = edit_align.align_long(pairs.select(F.col("pair").alias("name"), F.col("seq").alias("query"), F.col("_draft").alias("ref")), mode, **chunking)
    rows = found.withColumnRenamed("name", "pair").join(pairs.select("pair", "name", "seq"), "pair")
    again = F.when((F.col("piece") == 0) & (F.col("part") == 0), 0).otherwise(1)
    lead = F.regexp_extract("cigar", r"^(\d+)=", 1).try_cast("int")
    rest = F.concat(F.when(lead > 1, F.concat((lead - 1).cast("string"), F.lit("="))).otherwise(""), F.regexp_replace("cigar", r"^\d+=", ""))
    return rows.select(
        F.col("pair").alias("qname"),
        F.lit(0).alias("flag"),
        F.col("name").alias("ref_name"),
        (F.col("start") + again).cast("long").alias("pos"),
        F.lit(60).alias("mapq"),
        F.when(again == 0, F.col("cigar")).otherwise(rest).alias("cigar"),
        F.substr("seq", (F.col("q_start") + 1 + again).cast("int"), (F.col("q_end") - F.col("q_start") - again).cast("int")).alias("seq"),
        F.lit(None).cast("array<int>").alias("qual"),
        F.lit(None).cast("map<string,string>").alias("tags"),
    ).where("cigar <> ''")


def _seen(parts: list[list[edit_align.Part]], reads: list[str]) -> tuple[np.ndarray, ...]:
    """Of all bases and deletions that ``reads.observations`` gives of each read's alignments: the read's number, major, minor and code."""
    runs, sizes = [], [len(r) for r in reads]
    for k, (found, offset) in enumerate(zip(parts, np.cumsum([0, *sizes[:-1]]).tolist(), strict=True)):
        for part, (q, _, r, _, ops) in enumerate(found):
            # The match that a chunk begins with was seen in the one before it.
            skipped = 1 if part and q < found[part - 1][1] else 0
            first = r + skipped
            for n, op in ops:
                if n > skipped and (op != "I" or r > first):
                    runs.append((k, ord(op), n - skipped, r + skipped, offset + q + skipped))
                q, r, skipped = q + n * (op != "D"), r + n * (op != "I"), 0
    if not runs:
        return (np.zeros(0, np.int64),) * 4
    read, op, n, ref, at = np.array(runs, np.int64).T
    run = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    inserted, deleted = (op == ord("I"))[run], (op == ord("D"))[run]
    text = np.frombuffer("".join(reads).encode("latin-1", "replace") + b" ", np.uint8)
    code = np.where(deleted, 9, CODES[text[np.where(deleted, 0, at[run] + step)]])
    return read[run], np.where(inserted, ref[run] - 1, ref[run] + step), np.where(inserted, step + 1, 0), code


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of ``keys`` in order, the last column last, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    widths = [int(top).bit_length() for top in keys.max(axis=0)]
    if sum(widths) < 64:
        # One number for a row sorts much faster than its columns.
        packed = np.zeros(len(keys), np.int64)
        for column, width in zip(keys.T, widths, strict=True):
            packed = packed << width | column
        order = np.argsort(packed)
        packed = packed[order]
        new = packed[1:] != packed[:-1]
    else:
        order = np.lexsort(keys.T[::-1])
        new = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
    begins = np.flatnonzero(np.concatenate([[True], new]))
    return keys[order[begins]], np.add.reduceat(counts[order], begins)


PILE = "_major array<bigint>, _minor array<bigint>, _code array<tinyint>, _n array<bigint>"


def _piles(pairs: DataFrame, mode: str) -> DataFrame:
    """name and counts by major, minor and code of reads aligned to their draft, from pairs (name, query, ref): of each draft a row for each batch of its reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, edit_align.SIDE_PAIRS) for at in range(0, whole.num_rows, edit_align.SIDE_PAIRS)):
                queries, refs = batch.column("query").to_pylist(), batch.column("ref").to_pylist()
                read, major, minor, code = _seen(edit_align.chains([edit_align.steps(q, r, mode=mode) for q, r in zip(queries, refs, strict=True)]), queries)
                coded = pa.array(batch.column("name")).dictionary_encode()
                keys, n = _summed(np.stack([coded.indices.to_numpy()[read], major, minor, code], axis=1).astype(np.int64), np.ones(len(read), np.int64))
                names, sizes = np.unique(keys[:, 0], return_counts=True)
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((keys[:, 1], pa.int64()), (keys[:, 2], pa.int64()), (keys[:, 3], pa.int8()), (n, pa.int64()))]
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(names)), *lists], names=["name", "_major", "_minor", "_code", "_n"])

    return pairs.mapInArrow(run, f"name {dict(pairs.dtypes)['name']}, {PILE}")


def _features(column: np.ndarray, counts: np.ndarray, symmetric: bool = False, normalise: str | None = "total") -> np.ndarray:
    """The ``counts`` encoder's features (``normalise``: total or None; see ``encoders.counts``) of columns (draft, major, minor) in order, with their ``counts``."""
    begins = np.concatenate([[True], (column[1:, :2] != column[:-1, :2]).any(axis=1)])
    first = np.maximum.accumulate(np.where(begins, np.arange(len(column)), 0))
    if symmetric:
        for deleted, own in ((8, [0, 1, 2, 3, 8]), (9, [4, 5, 6, 7, 9])):
            here = counts[:, own].sum(axis=1)
            counts[:, deleted] = np.where(column[:, 2] > 0, here[first] - here, counts[:, deleted])
    return (counts / np.maximum(1, counts.sum(axis=1)[first])[:, None] if normalise else counts).astype(np.float32)


def _called(pieces: list[tuple[int, int]], features: np.ndarray, model: Callable[[np.ndarray], np.ndarray], chunking: tuple[int, int]) -> np.ndarray:
    """Class of each column: those of a piece in chunks (size, overlap) as ``pipelines.features`` cuts them, overlaps halved; chunks of one length go to the model together."""
    size, step = chunking[0], chunking[0] - chunking[1]
    by_length: dict[int, list[tuple[int, int, int]]] = {}
    for low, high in pieces:
        starts = [low] if high - low < size else sorted({*range(low, high - size + 1, step), high - size})
        ends = [min(s + size, high) for s in starts]
        cuts = [low, *[s + (e - s) // 2 for s, e in zip(starts[1:], ends, strict=False)], high]
        for s, e, a, b in zip(starts, ends, cuts, cuts[1:], strict=False):
            by_length.setdefault(e - s, []).append((s, a, b))
    out = np.zeros(len(features), np.int64)
    for length, chunks in by_length.items():
        some = max(1, COLUMNS // length)
        for at in range(0, len(chunks), some):
            s, a, b = np.array(chunks[at : at + some]).T
            place = s[:, None] + np.arange(length)
            best = model(features[place]).argmax(axis=-1)
            kept = (place >= a[:, None]) & (place < b[:, None])
            out[place[kept]] = best[kept]
    return out


def _texts(drafts: list[str], keys: np.ndarray, n: np.ndarray, model: Callable[[np.ndarray], np.ndarray], encoder: dict, chunking: tuple[int, int]) -> list[str]:
    """Drafts by their columns' counts; ``keys`` are the draft's number, major, minor and code, each once and in order."""
    if not len(keys):
        return drafts
    begins = np.concatenate([[True], (keys[1:, :3] != keys[:-1, :3]).any(axis=1)])
    column, counts = keys[begins, :3], np.zeros((int(begins.sum()), 11), np.int64)
    counts[np.cumsum(begins) - 1, keys[:, 3]] = n
    apart = np.flatnonzero(np.concatenate([[True], (column[1:, 0] != column[:-1, 0]) | (column[1:, 1] - column[:-1, 1] > 1)]))
    pieces = list(zip(apart.tolist(), [*apart[1:].tolist(), len(column)], strict=True))
    called = _called(pieces, _features(column, counts[:, :10], **encoder), model, chunking)
    symbols = np.frombuffer(CLASS_SYMBOLS.encode(), np.uint8)[called].tobytes().decode()
    parts: list[list[str]] = [[] for _ in drafts]
    at = [0] * len(drafts)
    for (low, high), draft, start, end in zip(pieces, column[apart, 0].tolist(), column[apart, 1].tolist(), column[[high - 1 for _, high in pieces], 1].tolist(), strict=True):
        parts[draft] += [drafts[draft][at[draft] : start], symbols[low:high].replace("*", "")]
        at[draft] = end + 1
    # All reads may lack a whole draft; its empty consensus is no draft to go on with.
    return ["".join([*p, d[a:]]) or d for p, d, a in zip(parts, drafts, at, strict=True)]


def _round(going: DataFrame, subreads: DataFrame, model: Callable[[np.ndarray], np.ndarray], encoder: dict, mode: str) -> DataFrame:
    """Drafts (name, seq, rounds) with _new: what a round makes of them. A read goes to its draft once and a draft's counts once; no base is a row.

    Reads are counted where they are aligned, so many reads of one draft are spread over tasks; the rows of a draft then stream through one.
    """
    pairs = subreads.where("seq is not null and name is not null").select("name", F.col("seq").alias("query")).join(going.select("name", F.col("seq").alias("ref")), "name")
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (part.split() for part in PILE.split(", "))]
    counted = _piles(pairs, mode).select("name", F.lit(None).cast("string").alias("seq"), F.lit(None).cast("int").alias("rounds"), "_major", "_minor", "_code", "_n")
    rows = spread(going.select("name", "seq", "rounds", *none).unionByName(counted), "name").sortWithinPartitions("name", F.col("seq").isNull())
    kind, chunking = dict(going.dtypes)["name"], (pipelines.CHUNK, pipelines.OVERLAP)

    def flat(column: pa.Array) -> np.ndarray:
        return np.asarray(column.flatten(), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_draft, keys, n = None, np.zeros((0, 4), np.int64), np.zeros(0, np.int64)

        def done(heads: pa.RecordBatch, upto: np.ndarray) -> pa.RecordBatch:
            new = _texts(heads.column("seq").to_pylist(), keys[upto], n[upto], model, encoder, chunking)
            return pa.RecordBatch.from_arrays([*heads.columns, pa.array(new, pa.string())], names=["name", "seq", "rounds", "_new"])

        for batch in batches:
            # A draft's own row is before those of its counts.
            is_head = batch.column("seq").is_valid().to_numpy(zero_copy_only=False)
            heads = batch.select(["name", "seq", "rounds"]).filter(pa.array(is_head))
            carried = 0 if open_draft is None else 1
            draft = np.cumsum(is_head) - 1 + carried
            sizes = batch.column("_major").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            more = np.stack([np.repeat(draft, sizes), *[flat(batch.column(c)) for c in ("_major", "_minor", "_code")]], axis=1)
            keys, n = _summed(np.concatenate([keys, more]), np.concatenate([n, flat(batch.column("_n"))]))
            if carried:
                heads = pa.Table.from_batches([open_draft, heads]).combine_chunks().to_batches()[0]
            last = heads.num_rows - 1
            if last > 0:
                yield done(heads.slice(0, last), keys[:, 0] < last)
            # The last one may go on in the next batch; of it only sums are kept.
            mine = keys[:, 0] == last
            open_draft, keys, n = heads.slice(last), keys[mine] * [0, 1, 1, 1], n[mine]
        if open_draft is not None:
            yield done(open_draft, np.ones(len(keys), bool))

    return rows.mapInArrow(run, f"name {kind}, seq string, rounds int, _new string")


def _round_by_columns(going: DataFrame, subreads: DataFrame, model: Callable[[np.ndarray], np.ndarray], config: dict, mode: str) -> DataFrame:
    """``_round`` for drafts of any length and any encoder: a base is a row."""
    # Both written, as what follows reads them several times and would align anew each time, in one very large plan.
    aligned = cut_lineage(aligned_reads(going, subreads, mode))
    columns = cut_lineage(pipelines.inference(aligned, model, config))
    new = pipelines.sequence(columns, going.select(F.col("name").alias("ref_name"), "seq")).select(F.col("ref_name").alias("name"), F.col("seq").alias("_new"))
    # All reads may lack a whole draft; its empty consensus is no draft to go on with.
    joined = going.join(new.where("_new <> ''"), "name", "left")
    return joined.select("name", "seq", "rounds", F.coalesce("_new", "seq").alias("_new"))


def polish(
    drafts: DataFrame,
    subreads: DataFrame,
    rounds: int = 5,
    model: Callable[[np.ndarray], np.ndarray] = encoders.majority_model,
    config: dict | None = None,
    mode: str = "NW",
    whole: int = WHOLE,
) -> DataFrame:
    """name, seq, rounds, settled: drafts (name, seq) polished by their reads (name, read, seq) for up to ``rounds`` rounds.

    All drafts go through a round together; one that came out as it went in is settled and leaves, so a round writes and reads only
    what still changes. ``rounds`` in the result counts those that changed the draft; a draft that still changed in the last one is not
    ``settled``. Drafts of up to ``whole`` bases are put together each in one task (with the ``counts`` encoder only). Names of drafts, and of the reads of one, are unique. Bases are in upper case. A draft without reads, and stretches
    that no read covers, stay as they are; an empty or null draft has nothing to align to and stays.
    """
    if rounds < 1:
        raise ValueError(f"rounds is at least 1, not {rounds}")
    config = config or SYMMETRIC
    ship(drafts.sparkSession)
    # Written before anything is asked of it: a condition on drafts may be pushed to whatever they are joined with, and drafts made anew for each row there.
    start = cut_lineage(drafts.select("name", F.upper("seq").alias("seq"), F.lit(0).alias("rounds")))
    alignable = (F.coalesce(F.length("seq"), F.lit(0)) > 0) & F.col("name").isNotNull()
    done, going = [start.where(~alignable).withColumn("settled", F.lit(True))], start.where(alignable)
    encoder = config.get("kwargs", {})
    countable = config["type"] == "counts" and encoder.get("normalise", "total") in ("total", None)
    for k in range(1, rounds + 1):
        is_short = F.length("seq") <= (whole if countable else 0)
        ways = [(going.where(is_short), lambda some: _round(some, subreads, model, encoder, mode)), (going.where(~is_short), lambda some: _round_by_columns(some, subreads, model, config, mode))]
        news = [way(some) for some, way in ways if not some.isEmpty()]
        if not news:
            break
        joined = reduce(DataFrame.unionByName, news)
        changed = F.col("_new") != F.col("seq")
        step = cut_lineage(joined.select("name", F.col("_new").alias("seq"), F.when(changed, k).otherwise(F.col("rounds")).alias("rounds"), (~changed).alias("settled")))
        done.append(step.where("settled"))
        going = step.where("not settled").drop("settled")
        if going.isEmpty():
            break
    return reduce(DataFrame.unionByName, [*done, going.withColumn("settled", F.lit(False))])
