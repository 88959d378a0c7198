"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import logging
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Bytes that separate words when words are runs of anything but ASCII white space.
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])
#: ASCII bytes that separate words when words are letters, digits and non-ASCII characters.
MARK_BYTES = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def word_table(separators: bytes) -> bytes:
    """A table for bytes.translate: A-Z to lower case, separators to a blank."""
    table = bytearray(range(256))
    for a, b in zip(UPPER.encode(), LOWER.encode()):
        table[a] = b
    for c in separators:
        table[c] = 0x20
    return bytes(table)


SPACE_WORDS = word_table(SPACE_BYTES)
MARK_WORDS = word_table(MARK_BYTES)


def words_of(text: bytes | None, table: bytes = SPACE_WORDS) -> list[bytes]:
    """The words of UTF-8 text; none for null.

    bytes.split() without an argument also splits at 0x0B and 0x0C, which both tables
    have made blanks already, and at nothing else that a table leaves.
    """
    return text.translate(table).split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a session on one machine gets a temporary folder; any other is an error, as its executors
    would write to disks of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if context.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="corpus-")
        atexit.register(shutil.rmtree, _own_dirs[context.applicationId], ignore_errors=True)
    return _own_dirs[context.applicationId]


def settle(df: DataFrame, name: str, compression: str = "uncompressed") -> DataFrame:
    """Write a table in the shared folder and read it: lineage ends here.

    Most such tables hold hashes, which don't compress; without a codec writers need no native memory. Counts and texts do.

    What is computed once stays the same for every later reader, also after the loss of
    executors, and it may hold values (such as batch ids) drawn at random by a task.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What a query run herein has shuffled is deleted as it ends, not when the driver next collects its garbage.

    For writes only: a plan that is run a second time would have to shuffle again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def batches(rows: Iterator, size_of, limit: int) -> Iterator[list]:
    """Lists of consecutive rows whose sizes sum to limit or just above; none is empty."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size_of(row)
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held


def columns_of(it, *names: str) -> Iterator[tuple]:
    """Rows, as tuples of Python values, of Arrow batches; a batch is sliced to bound memory."""
    for batch in it:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names))


def discard(*tables: DataFrame) -> None:
    """Delete tables that settle() wrote and that nothing will read again."""
    for df in tables:
        if path := getattr(df, "_settled", None):
            discard_path(df.sparkSession, path)


def discard_path(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


FILTER_BITS = 1 << 24


def id_filter(ids: DataFrame, column: str) -> DataFrame:
    """A bit map of hashed ids, as (_word, _mask): at most FILTER_BITS / 64 = 262,144 rows, however many ids there are."""
    hashed = ids.select(F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)).alias("h"))
    return hashed.groupBy(F.shiftright("h", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 AS int)))").alias("_mask"))


def split_by(docs: DataFrame, column: str, bits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs that may be among the ids of the bit map, docs that surely aren't), by a broadcast of bounded size.

    So a join that concerns few rows shuffles few texts. The first part needs an exact join yet.
    """
    names = docs.columns
    h = F.pmod(F.xxhash64(F.col(f"_row.{column}")), F.lit(FILTER_BITS))
    held = docs.select(F.struct(*names).alias("_row")).withColumn("_h", h).withColumn("_word", F.shiftright("_h", 6))
    met = held.join(F.broadcast(bits), "_word", "left").withColumn("_may", F.expr("coalesce(getbit(_mask, cast(_h & 63 AS int)), 0) = 1"))
    return met.filter("_may").select("_row.*"), met.filter("NOT _may").select("_row.*")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Have Spark hand texts to Python at most so many at a time: some MB, instead of tens, a task.

    A setting of the session, as plans read it when they run; what it was and is goes to the log.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key, "10000")
    if not 0 < int(was) <= rows:
        logging.getLogger(__name__).warning("%s: %s lowered to %d", key, was, rows)
        spark.conf.set(key, str(rows))


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    """The Arrow type of a column, whatever it is."""
    return to_arrow_type(df.schema[column].dataType)


#: Places of the map of hot keys, which is part of a plan: a byte each.
HOT_PLACES = 1 << 16


def hot_map(keys: DataFrame, key: str) -> bytes | None:
    """A map of hashed keys, of HOT_PLACES bytes however many keys there are; None if there are none."""
    found = keys.select(F.pmod(F.xxhash64(key), F.lit(HOT_PLACES)).cast("int").alias("h")).distinct().collect()
    places = bytearray(HOT_PLACES)
    for r in found:
        places[r["h"]] = 1
    return bytes(places) if found else None


def salted_join(many: DataFrame, one: DataFrame, key: str, hot: bytes, spread: str, how: str = "inner", ways: int = 64) -> DataFrame:
    """many.join(one, key, how) for a table `one` with a row a key, where some keys have very many rows in `many`.

    hot: hot_map() of such keys. Their rows in `many` are dealt over `ways` tasks by the column `spread`, and their rows in
    `one` come as often. Keys that only share a hash with a hot one are dealt alike on both sides, so nothing is lost.
    """
    place = (F.pmod(F.xxhash64(key), F.lit(HOT_PLACES)) + 1).cast("int")
    may = F.substring(F.lit(bytearray(hot)), place, F.lit(1)) == F.lit(bytearray(b"\x01"))
    left = many.withColumn("_salt", F.when(may, F.pmod(F.xxhash64(spread, F.lit(1)), F.lit(ways)).cast("int")).otherwise(0))
    right = one.withColumn("_salt", F.explode(F.when(may, F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "_salt"], how).drop("_salt")
