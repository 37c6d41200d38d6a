"""What several operators share: tables in the shared folder, row keys, held-out splits, Python on the executors."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship

_written: list[str] = []


class Scratch:
    """Tables that an operator writes to the shared folder, which cuts lineage and survives lost executors.

    At the end of the ``with`` block all are deleted but those passed to ``keep``, which a lazy result still reads;
    ``release`` deletes these too.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for path in self.paths.values():
            _delete(self.spark, path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back."""
        path = f"{shared_dir(self.spark)}/strandlake-{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        # Held, so that its id stays its own.
        self.__dict__.setdefault("held", []).append(back)
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for table in tables:
            _delete(self.spark, self.paths.pop(id(table)))

    def keep(self, table: DataFrame) -> DataFrame:
        """``table``, which stays until ``release``."""
        _written.append(self.paths.pop(id(table)))
        return table


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; ``release`` deletes it."""
    with Scratch(df.sparkSession) as scratch:
        return scratch.keep(scratch.write(df, name))


def release(spark: SparkSession) -> None:
    """Delete the tables that results of this process still read. Results that were not saved can't be read after that."""
    while _written:
        _delete(spark, _written.pop())


#: Bits of a membership bitmap, at most; a bitmap of Spark's holds 32,768 of them in 4 KB, so that at most 16 MB are broadcast.
FILTER_BITS = 1 << 27


def marked(df: DataFrame, wanted: DataFrame, key: str, n: int, into: str) -> DataFrame:
    """``df`` plus the boolean column ``into``: whether its key is, or by chance seems to be, among the ``n`` of ``wanted``.

    One bit a hash of a key, and eight times as many bits as keys up to FILTER_BITS, so what is broadcast has a bound. With many
    more keys than that bound the bitmap is full and all rows are marked.
    """
    bits = min(FILTER_BITS, 1 << max(15, (8 * n).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    bucket, held = fresh(df, "_bucket"), fresh(df, "_bits")
    marks = wanted.groupBy(F.bitmap_bucket_number(place).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias(held))
    joined = df.withColumn(bucket, F.bitmap_bucket_number(place)).join(F.broadcast(marks), bucket, "left")
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(held, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return joined.withColumn(into, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop(bucket, held)


def maybe_in(df: DataFrame, wanted: DataFrame, key: str, n: int) -> DataFrame:
    """The rows of ``df`` that ``marked`` marks: what a later join has to shuffle."""
    name = fresh(df, "_maybe")
    return marked(df, wanted, key, n, name).where(F.col(name)).drop(name)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have, so that no column of the caller's is replaced."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def text_digest(text_col: str = "text") -> Column:
    """SHA-256 of a text, null as empty, in 32 bytes."""
    return F.unhex(F.sha2(text_or_empty(text_col), 256))


def keep_found(docs: DataFrame, found: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """``docs``, columns as they are, without the rows that ``found`` does not keep.

    ``found`` has doc_id, digest and kept, one row per row of ``docs``. Rows are found again by id and text, so rows that share
    one of them are told apart; of rows that share both, one stays if any is kept. What goes is written first, and its count
    sizes the bitmap that tells which rows are shuffled.
    """
    keys = found.groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    odd = scratch.write(keys.where("not kept or n > 1").select(_key(F.col("doc_id"), F.col("digest")).alias("k"), "kept"), "not-kept")
    name, maybe = fresh(docs, "_key"), fresh(docs, "_maybe")
    odd = scratch.keep(odd).select(F.col("k").alias(name), "kept")
    keyed = marked(docs.withColumn(name, _key(F.col(id_col).cast("long"), text_digest(text_col))), odd, name, odd.count(), maybe)
    # Only rows that may go are shuffled with their texts; the others are passed on where they are.
    sure, unsure = keyed.where(~F.col(maybe)), keyed.where(F.col(maybe))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rest = sure.select(*columns).unionByName(unsure.join(odd.select(name), name, "left_anti").select(*columns))
    twice = odd.where("kept").select(name)
    if twice.isEmpty():
        return rest
    # Rows that repeat wholly: their other columns may differ, and one row of each stays as it is.
    whole = unsure.join(twice, name, "left_semi").groupBy(name).agg(F.first(F.struct(*columns)).alias("row_"))
    return rest.unionByName(whole.select("row_.*"))


def _key(doc_id: Column, digest: Column) -> Column:
    return F.sha2(F.concat(digest, F.coalesce(doc_id.cast("string"), F.lit("none")).cast("binary")), 256)


def crc_bucket(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``: the split that keeps rows out of training."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(modulus))


#: Rows of a batch that a Python worker handles at once; texts are long, and a worker's memory has a bound.
BATCH_ROWS = 256


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """``df.mapInArrow`` with this package on the executors and batches of at most BATCH_ROWS rows, whatever the session's setting."""
    ship(df.sparkSession)

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(batch.slice(at, BATCH_ROWS) for batch in batches for at in range(0, batch.num_rows, BATCH_ROWS))

    return df.mapInArrow(small, schema)


