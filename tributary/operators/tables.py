"""Intermediate tables, row names and order."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.plans.spec import QueryError, Stream, estimated_bytes

#: Rows of a range or bucket that one task orders, about; their number grows with the table.
EACH = 1 << 14
HASH_BITS = 60

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a session on one machine gets a temporary folder; any other is
    an error, as its executors would write to disks of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if context.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="join-")
        atexit.register(shutil.rmtree, _own_dirs[context.applicationId], ignore_errors=True)
    return _own_dirs[context.applicationId]


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several later steps read; its lineage ends here."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/joins/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def part_of_name(df: DataFrame, column: str) -> Column:
    """A value as text, such that different values have different texts: null is \\N, and bars and backslashes are escaped.

    Times keep their microseconds; those of a time zone are counted from the epoch, as wall clocks repeat an hour.
    """
    c, kind = F.col(column), df.schema[column].dataType
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        raise QueryError(f"{column} can't be part of a row's name")
    if isinstance(kind, T.StringType):
        text = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    elif isinstance(kind, T.BinaryType):
        text = F.hex(c)
    else:
        text = (F.unix_micros(c) if isinstance(kind, T.TimestampType) else c).cast("string")
    return F.coalesce(text, F.lit("\\N"))


def rid(stream: Stream) -> Column:
    """A row's name as text: its rid columns, joined by bars."""
    if not stream.rid:
        raise QueryError(f"{stream.name} has no rid columns, which samples name rows by")
    parts = [part_of_name(stream.frame, c) for c in stream.rid]
    return F.concat_ws("|", *parts) if len(parts) > 1 else parts[0]


def hash60(text: Column) -> Column:
    """The first 60 bits of a text's MD5, as other engines can make them too: the order of rows, names deciding ties."""
    return F.conv(F.substring(F.md5(text.cast("string")), 1, 15), 16, 10).cast("long")


def bucket_bits(df: DataFrame, row_bytes: int = 64) -> int:
    """So many first bits of a hash that a bucket has at most about EACH rows of a table, by the planner's estimate of its size, 16 at least.

    The order of rows doesn't depend on it, only how many sums there are and how many rows a task orders.
    """
    size = estimated_bytes(df)
    return min(22, max(16, (size // row_bytes // EACH).bit_length() + 2))


def floor_div(c: Column, size: int) -> Column:
    """floor(c / size) in whole numbers, exact for any long."""
    size = F.lit(size).cast("long")
    c = c.cast("long")
    return F.call_function("div", c - F.pmod(c, size), size)


def step_of(df: DataFrame, order: str, each: int = EACH) -> tuple[int, int]:
    """(least, step) of a whole-number column, such that ranges of `step` hold about `each` rows where values are even."""
    found = df.agg(F.min(order).alias("a"), F.max(order).alias("b"), F.count("*").alias("n")).first()
    if not found["n"] or found["a"] is None:
        return 0, 1
    return int(found["a"]), max(1, (int(found["b"]) - int(found["a"]) + 1) // max(1, found["n"] // each))


def in_ranges(df: DataFrame, order: str, step: int | tuple[int, int] | None) -> DataFrame:
    """df with _range: the range of a whole-number column that a row is in, of so many values, or by step_of()."""
    low, step = step if isinstance(step, tuple) else (0, step) if step else step_of(df, order)
    return df.withColumn("_range", floor_div(F.col(order) - F.lit(low), step))


def arrival(df: DataFrame, by: list[str], order: str, step: int | tuple[int, int] | None = None) -> DataFrame:
    """df with _idx: from 0, the row's place among those with equal `by`, in the order of a whole-number column.

    Ranges of the order are counted first, then rows within a range; no task gets more than a range of a key.
    """
    ranged = in_ranges(df, order, step)
    counts = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy(*by, "_range").orderBy(order)) - 1
    return ranged.join(before, [*by, "_range"]).withColumn("_idx", F.col("_before") + inside).drop("_range", "_before")


def running(df: DataFrame, order: str, value: Column, out: str, how: str = "sum", step: int | tuple[int, int] | None = None) -> DataFrame:
    """df with the running sum, least or greatest of a value, in the order of a whole-number column, the row included.

    Ranges of the order are combined first, in one task that gets a row a range; then rows within each range.
    """
    combine = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    ranged = in_ranges(df.withColumn("_v", value), order, step)
    tops = ranged.groupBy("_range").agg(combine("_v").alias("_top"))
    before = tops.withColumn("_before", combine("_top").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))).drop("_top")
    inside = combine("_v").over(W.partitionBy("_range").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    both = F.coalesce(F.col("_before") + inside, "_before", inside) if how == "sum" else (F.least if how == "min" else F.greatest)(F.col("_before"), inside)
    return ranged.join(before, "_range").withColumn(out, both).drop("_range", "_v", "_before")


def running_by(df: DataFrame, by: list[str], order: str, sums: dict[str, str], kind: str, span: int = 1 << 12) -> DataFrame:
    """df with running sums, the row included, of columns among rows with equal `by`, in the order of a whole-number column.

    sums: from the new column to the summed one. A key's sums over spans of the order come first, so no task gets more than a span of a key.
    """
    ranged = df.withColumn("_span", floor_div(F.col(order), span))
    tops = ranged.groupBy(*by, "_span").agg(*[F.sum(c).cast(kind).alias(f"_top_{o}") for o, c in sums.items()])
    earlier = W.partitionBy(*by).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    before = tops.select(*by, "_span", *[F.coalesce(F.sum(f"_top_{o}").over(earlier), F.lit(0)).cast(kind).alias(f"_before_{o}") for o in sums])
    inside = W.partitionBy(*by, "_span").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = ranged.join(before, [*by, "_span"])
    return out.withColumns({o: (F.col(f"_before_{o}") + F.sum(c).over(inside)).cast(kind) for o, c in sums.items()}).drop("_span", *[f"_before_{o}" for o in sums])
