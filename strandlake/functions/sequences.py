"""Column functions on sequences, CIGAR strings, names, tags and qualities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Which CIGAR operations advance along the reference and along the read.
ON_REFERENCE, ON_READ = "M=XDN", "M=XIS"


def reverse_complement(seq: Column) -> Column:
    """Case is kept, and so is every symbol outside ACGT."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def valid_symbols(seq: Column, symbols: str = "ACGTacgt") -> Column:
    """Whether nothing but ``symbols`` stands in the sequence."""
    return seq.rlike(f"^[{symbols}]*\\z")


def cigar_ops(cigar: Column) -> Column:
    """array<struct<n:int, op:string>>."""
    tokens = F.regexp_extract_all(cigar, F.lit(r"(\d+\D)"), F.lit(1))
    return F.transform(tokens, lambda t: F.struct(F.substr(t, F.lit(1), F.length(t) - 1).cast("int").alias("n"), F.substr(t, F.lit(-1)).alias("op")))


def cigar_length(cigar: Column, kinds: str) -> Column:
    """Summed lengths of the operations in ``kinds``: ON_REFERENCE gives the covered reference, ON_READ the read."""
    return F.aggregate(F.filter(cigar_ops(cigar), lambda o: F.contains(F.lit(kinds), o["op"])), F.lit(0), lambda total, o: total + o["n"])


def reference_end(pos: Column, cigar: Column) -> Column:
    return pos + cigar_length(cigar, ON_REFERENCE)


def trim_cigar_start(cigar: Column) -> Column:
    """struct<cigar, query_trim, ref_offset>: what stands before the first ``=`` is taken off.

    Found by the text alone, so that only the few operations before it are taken apart, not the whole CIGAR.
    """
    before = F.rtrim(F.substring_index(cigar, "=", 1), F.lit("0123456789"))
    rest = F.when(F.contains(cigar, F.lit("=")), F.substr(cigar, F.length(before) + 1))
    return F.struct(F.coalesce(rest, F.lit("")).alias("cigar"), cigar_length(before, ON_READ).alias("query_trim"), cigar_length(before, ON_REFERENCE).alias("ref_offset"))


def add_clipping(cigar: Column, start: int, end: int) -> Column:
    """Soft clips added at both ends, merged with those that are there."""
    have = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(cigar, pattern, 1), F.lit("")).cast("int"), F.lit(0))
    head, tail = have(r"^(\d+)S") + start, have(r"(\d+)S$") + end
    core = F.regexp_replace(F.regexp_replace(cigar, r"^\d+S", ""), r"\d+S$", "")
    clip = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("S"))).otherwise("")
    return F.concat(clip(head), core, clip(tail))


def homopolymer_runs(seq: Column) -> Column:
    """array<string>: maximal runs of one symbol, in order."""
    return F.transform(F.regexp_extract_all(seq, F.lit(r"((.)\2*)"), F.lit(1)), lambda run: run)


def compress_homopolymers(seq: Column, block: int | None = None, most: int = 93) -> Column:
    """struct<seq, runs>: one symbol a run, or a run of at most ``block``, and run lengths as characters of code length + 33."""
    runs = homopolymer_runs(seq)
    if block:
        pieces = F.flatten(
            F.transform(runs, lambda run: F.transform(F.sequence(F.lit(0), F.floor((F.length(run) - 1) / block)), lambda k: F.substr(run, k * block + 1, F.lit(block))))
        )
    else:
        pieces = runs
    symbols = F.array_join(F.transform(pieces, lambda run: F.substr(run, F.lit(1), F.lit(1))), "")
    lengths = F.array_join(F.transform(pieces, lambda run: F.char(F.least(F.length(run), F.lit(most)) + 33)), "")
    return F.struct(symbols.alias("seq"), lengths.alias("runs"))


def phred(error: Column, cap: float = 70.0) -> Column:
    """-10 log10 of the error clipped to [1e-7, 1], at most ``cap``."""
    return F.least(F.lit(cap), -10 * F.log10(F.least(F.lit(1.0), F.greatest(F.lit(1e-7), error))))


def phred_char(quality: Column) -> Column:
    return F.char(F.floor(quality) + 33)


def accuracy_quality(accuracy: Column) -> Column:
    return -10 * F.log10(F.greatest(F.lit(1e-6), 1 - accuracy))


def info_to_string(info: Column) -> Column:
    """Sorted key=value pairs joined by semicolons; an empty value is a bare flag; ``.`` for none."""
    pairs = F.array_sort(F.map_entries(info))
    text = F.array_join(F.transform(pairs, lambda e: F.when(F.coalesce(e["value"], F.lit("")) == "", e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return F.when(info.isNull() | (F.size(info) == 0), F.lit(".")).otherwise(text)


def string_to_info(text: Column) -> Column:
    """map<string,string>; bare flags have an empty value."""
    parts = F.filter(F.split(text, ";"), lambda p: (p != "") & (p != "."))
    pairs = F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1), F.regexp_extract(p, r"=(.*)$", 1)))
    return F.map_from_entries(pairs)


def region_parse(text: Column) -> Column:
    """struct<ref_name, start, end> of ``c:10-20``, ``c:10``, ``c:-10``, ``c:10-`` or ``c``; open ends are null."""
    has = text.rlike(r":\d*-?\d*$")
    name = F.when(has, F.regexp_extract(text, r"^(.*):", 1)).otherwise(text)
    span = F.when(has, F.regexp_extract(text, r":([^:]*)$", 1)).otherwise("")
    start = F.when(span.startswith("-"), F.lit(0)).otherwise(F.nullif(F.regexp_extract(span, r"^(\d*)", 1), F.lit("")).cast("long"))
    end = F.nullif(F.regexp_extract(span, r"-(\d*)$", 1), F.lit("")).cast("long")
    return F.struct(name.alias("ref_name"), start.cast("long").alias("start"), end.alias("end"))


def region_format(ref: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s:%d-%d", ref, start, end)


def sample_name(ref: Column, major0: Column, minor0: Column, major1: Column, minor1: Column) -> Column:
    return F.format_string("%s:%d.%d-%d.%d", ref, major0, minor0, major1, minor1)


def sample_name_parse(name: Column) -> Column:
    pattern = r"^(.*):(\d+)\.(\d+)-(\d+)\.(\d+)$"
    part = lambda k: F.regexp_extract(name, pattern, k)
    return F.struct(
        part(1).alias("ref_name"),
        *[part(k).cast("long").alias(c) for k, c in enumerate(("start_major", "start_minor", "end_major", "end_minor"), 2)],
    )


def natural_key(text: Column) -> Column:
    """Orders chr2 before chr10: digits are padded with zeros."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 18, "0")).otherwise(p)), "")


def move_table_dwells(moves: Column, stride: Column, reverse: Column) -> Column:
    """Samples spent in each base: distances of ones in a move table times the stride, at most 127; reversed for reverse reads."""
    ones = F.filter(F.transform(F.arrays_zip(moves.alias("m"), F.sequence(F.lit(1), F.size(moves)).alias("i")), lambda x: F.when(x["m"] == 1, x["i"])), lambda i: i.isNotNull())
    ends = F.concat(F.slice(ones, F.lit(2), F.size(ones)), F.array(F.size(moves) + 1))
    dwell = F.zip_with(ones, ends, lambda a, b: F.least(F.lit(127), ((b - a) * stride).cast("int")))
    dwell = F.when(F.size(ones) > 0, dwell)
    return F.when(reverse, F.reverse(dwell)).otherwise(dwell)


def apply_edits(seq: Column, edits: Column) -> Column:
    """``seq`` with sorted, disjoint edits array<struct<pos, ref, alt>> (0-based) put in."""
    done = F.aggregate(
        edits,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda s, e: F.struct(
            F.concat(s["out"], F.substr(seq, (s["at"] + 1).cast("int"), (e["pos"] - s["at"]).cast("int")), e["alt"]).alias("out"),
            (e["pos"] + F.length(e["ref"])).cast("long").alias("at"),
        ),
    )
    return F.concat(done["out"], F.substr(seq, (done["at"] + 1).cast("int"), F.length(seq)))


def run_of(position: Column, seq: Column) -> Column:
    """The run, from 0, of a homopolymer-compressed sequence that holds a position, from 0, of the full one."""
    head = F.substr(seq, F.lit(1), (position + 1).cast("int"))
    return F.size(homopolymer_runs(head)) - 1


def run_starts(seq: Column) -> Column:
    """array<int>: where, from 0, each run begins in the full sequence."""
    empty = F.array().cast("array<int>")
    done = F.aggregate(
        homopolymer_runs(seq),
        F.struct(empty.alias("out"), F.lit(0).alias("at")),
        lambda s, run: F.struct(F.concat(s["out"], F.array(s["at"])).alias("out"), (s["at"] + F.length(run)).alias("at")),
    )
    return done["out"]


#: Fields of a record name, in order.
RECORD_FIELDS = ("query_name", "ref_name", "ref_start", "ref_end", "padded_start", "padded_end", "strand", "hap", "phased_set", "ploidy")


def record_name(*fields: Column) -> Column:
    """Ten fields joined by underscores; the query name may hold underscores itself."""
    if len(fields) != len(RECORD_FIELDS):
        raise ValueError(f"a record name has {len(RECORD_FIELDS)} fields")
    return F.concat_ws("_", *[f.cast("string") for f in fields])


def record_name_parse(name: Column) -> Column:
    """struct of RECORD_FIELDS, counted from the end, so that no pattern is matched again and again for each; text that is no record name has empty ones and null numbers."""
    whole = ("ref_start", "ref_end", "padded_start", "padded_end", "hap", "phased_set", "ploidy")
    n = len(RECORD_FIELDS) - 1
    last = F.substring_index(name, "_", -n)
    named = F.length(last) < F.length(name)
    field = lambda k: F.substring_index(F.substring_index(name, "_", k - n - 1), "_", 1)
    text = [F.substr(name, F.lit(1), F.length(name) - F.length(last) - 1), *[field(k) for k in range(1, n + 1)]]
    blank = F.when(name.isNotNull(), "")
    parts = [(F.when(named, t).otherwise(blank), f) for t, f in zip(text, RECORD_FIELDS, strict=True)]
    return F.struct(*[(c.cast("long") if f in whole else c).alias(f) for c, f in parts])


def pad_array(values: Column, size: int, fill: Column) -> Column:
    return F.concat(values, F.array_repeat(fill, F.greatest(F.lit(0), F.lit(size) - F.size(values))))


def apply_checked(seq: Column, edits: Column) -> Column:
    """struct<seq, substituted, inserted, deleted, skipped>: like ``apply_edits``, but edits that overlap an earlier one or whose ref is not there are skipped and counted."""
    zero = F.lit(0)
    names = ("substituted", "inserted", "deleted", "skipped")
    start = F.struct(F.lit("").alias("out"), zero.cast("long").alias("at"), *[zero.alias(n) for n in names])

    def step(s: Column, e: Column) -> Column:
        good = (e["pos"] >= s["at"]) & (F.substr(seq, (e["pos"] + 1).cast("int"), F.length(e["ref"])) == e["ref"])
        more = F.length(e["alt"]) - F.length(e["ref"])
        put = F.concat(s["out"], F.substr(seq, (s["at"] + 1).cast("int"), (e["pos"] - s["at"]).cast("int")), e["alt"])
        kinds = {"substituted": good & (more == 0), "inserted": good & (more > 0), "deleted": good & (more < 0), "skipped": ~good}
        return F.struct(
            F.when(good, put).otherwise(s["out"]).alias("out"),
            F.when(good, e["pos"] + F.length(e["ref"])).otherwise(s["at"]).cast("long").alias("at"),
            *[(s[n] + F.when(kinds[n], 1).otherwise(0)).alias(n) for n in names],
        )

    done = F.aggregate(edits, start, step)
    return F.struct(F.concat(done["out"], F.substr(seq, (done["at"] + 1).cast("int"), F.length(seq))).alias("seq"), *[done[n].alias(n) for n in names])
