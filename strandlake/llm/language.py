"""Language identification by compression.

For each language a raw-content zstandard dictionary is made of a bounded sample of its
texts. A text's words, lower-cased, are encoded, in blocks, with each dictionary in turn; the language whose
dictionary gives the fewest bytes wins. A narrow margin to the second rejects
the decision.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_bucket, map_batches

UNKNOWN, NO_LETTERS = "und", re.compile(r"[\W\d_]+")
#: Bounds of the training sample: languages (those of most texts), texts of one language, bytes of one text and of one dictionary.
LANGUAGES, SAMPLE_TEXTS, TEXT_BYTES, DICTIONARY_BYTES = 512, 64, 2048, 1 << 16
#: A longer text gives runs of so many words, at even distances over all of it.
RUN = 12
BLOCK, LEVEL, MARGIN = 1 << 14, 3, 0.002
#: So many bytes of a dictionary stand before each block instead of in the dictionary, and their cost is taken off:
#: a short text is then encoded with the language's symbol statistics too, which a raw-content dictionary lacks.
PRIME = 4096


def letters(text: str) -> str:
    """The text's words of letters, lower-cased: marks, digits and layout say nothing of a language."""
    return NO_LETTERS.sub(" ", text.lower()).strip()


def thinned(text: str, size: int = TEXT_BYTES) -> str:
    """The words of ``text`` if they fit in ``size`` bytes; else runs of RUN words from its beginning to its end, as many as fit."""
    words = letters(text)
    whole = len(words.encode("utf-8", "replace"))
    if whole <= size:
        return words
    parts = words.split()
    runs = [" ".join(parts[at : at + RUN]) for at in range(0, len(parts), RUN)]
    for n in range(max(1, len(runs) * size // whole), 0, -1):
        some = " ".join(runs[k * len(runs) // n] for k in range(n))
        if len(some.encode("utf-8", "replace")) <= size:
            return some
    return ""


def _thin_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.array([thinned(t.as_py() or "") for t in batch.column(2)], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["lang", "id", "text"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: Column | None = None) -> dict[str, bytes]:
    """Dictionaries by language, from rows with id, text and language for which ``held_out`` is false.

    Of each of the LANGUAGES languages with most texts at most SAMPLE_TEXTS ids are used: the least hash of id in each of as many slots. An id
    counts once in a language: of rows that share it, the least text. So many bytes reach the driver as the bounds say.
    An empty table gives no dictionary; a language of a few bytes has none.
    """
    usable = F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()
    rows = docs.where(usable if held_out is None else usable & ~held_out)
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    hashed = F.xxhash64(F.lit("language sample"), "id")
    slots = rows.select("lang", "id", hashed.alias("h"), F.pmod(hashed, F.lit(SAMPLE_TEXTS)).alias("slot"))
    slots = slots.groupBy("lang", "slot").agg(F.min(F.struct("h", "id")).alias("least"), F.count(F.lit(1)).alias("n"))
    with Scratch(docs.sparkSession) as scratch:
        slots = scratch.write(slots.select("lang", F.col("least.id").alias("id"), "n"), "language-slots")
        most = slots.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
        picked = scratch.write(slots.join(F.broadcast(most.select("lang")), "lang", "left_semi").select("lang", "id"), "language-ids")
        texts = rows.join(F.broadcast(picked), ["lang", "id"])
        texts = map_batches(texts.select("lang", "id", "text"), _thin_batches, "lang string, id long, text string")
        found = defaultdict(list)
        for r in sorted(texts.groupBy("lang", "id").agg(F.min("text").alias("text")).collect()):
            found[r["lang"]].append(r["text"].encode("utf-8", "replace"))
    dictionaries = {}
    for lang, parts in found.items():
        # A text that would pass the bound of a dictionary stays out of it.
        content = b""
        for part in parts:
            if len(content) + len(part) + 1 <= DICTIONARY_BYTES:
                content += part + b"\n"
        if len(content) >= 8 + len(parts):
            dictionaries[lang] = content
    return dictionaries


class Encoders:
    """One compressor for each language, made once in a worker."""

    def __init__(self, dictionaries: dict[str, bytes]):
        frame = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0)
        self.by_lang = []
        for lang, content in sorted(dictionaries.items()):
            prime, rest = content[:PRIME] + b"\n", content[PRIME:]
            if len(rest) < 8:
                prime, rest = b"", content
            raw = zstandard.ZstdCompressionDict(rest, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(compression_params=frame)
            encoder = zstandard.ZstdCompressor(dict_data=raw, compression_params=frame)
            self.by_lang.append((lang, prime, encoder, len(encoder.compress(prime))))

    def decide(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the decision is rejected."""
        words = letters(text or "")
        if not self.by_lang or not any(map(str.isalpha, words)):
            return UNKNOWN, 0.0, True
        data = words.encode("utf-8", "replace")
        parts = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
        sizes = sorted((max(1, sum(len(encoder.compress(prime + p)) - cost for p in parts)), lang) for lang, prime, encoder, cost in self.by_lang)
        best, lang = sizes[0]
        margin = (sizes[1][0] - best) / sizes[1][0] if len(sizes) > 1 else 1.0
        return lang, 1 - 0.5 * math.exp(-20 * margin), margin < MARGIN


def detect(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected: one row per row of ``docs``, rows that repeat or share an id too.

    Text that is null, empty or has no letter is ``und`` and rejected. Of languages with equal sizes the first by name is given, and
    rejected for lack of margin. Texts are encoded whole, other columns are not read, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(dictionaries)
        for batch in batches:
            found = [encoders.decide(t.as_py()) for t in batch.column(1)]
            langs, scores, rejected = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "doc_id long, lang_pred string, score double, rejected boolean")


def drop_rejected(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """``docs`` without rows whose language is rejected, columns as they are, whatever their names; no join, no shuffle. Cases as in ``detect``."""
    columns = list(docs.columns)
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(dictionaries)
        for batch in batches:
            yield batch.filter(pa.array([not encoders.decide(t.as_py())[2] for t in batch.column(at)], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    return crc_bucket(4, id_col) == 2
