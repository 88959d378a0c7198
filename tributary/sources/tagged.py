"""Tagged lines: <SID>|<csv> inserts a row, d <SID> <n> deletes the n oldest, - asks for a report, an empty line ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a text file, or of a folder's files in the order of their names; line_no counts from 0."""
    return in_order(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b")))


def in_order(lines: DataFrame, first: int = 0) -> DataFrame:
    """(line_no, value) of lines (value, f, b) that know their file and the place in it where the task began to read.

    Files come by name, and a file's parts by place; lines are numbered without gaps from `first`. Lines without a place come in
    the order of their partitions.
    """
    i = F.monotonically_increasing_id()
    lines = lines.withColumn("i", i).withColumn("b", F.coalesce("b", F.shiftright("i", 33)))
    parts = lines.groupBy("f", "b").agg(F.min("i").alias("low"), F.count("*").alias("n")).collect()  # a row a split of the input
    ranks, at = [], first
    for r in sorted(parts, key=lambda r: (r["f"], r["b"])):
        ranks.append((r["f"], r["b"], r["low"], at))
        at += r["n"]
    if not ranks:
        return lines.select(F.col("i").alias("line_no"), "value")
    starts = lines.sparkSession.createDataFrame(ranks, "f string, b long, low long, start long")
    return lines.join(F.broadcast(starts), ["f", "b"]).select((F.col("start") + F.col("i") - F.col("low")).alias("line_no"), "value")


def parse_log(lines: DataFrame, line_no: str = "line_no", value: str = "value") -> DataFrame:
    """(line_no, kind, sid, n, payload): kind is insert, delete or report. What follows an empty line is not read."""
    text = F.col(value)
    rows = lines.select(F.col(line_no).alias("line_no"), text.alias("value"))
    end = rows.filter(F.length("value") == 0).agg(F.min("line_no")).first()[0]
    if end is not None:
        rows = rows.filter(F.col("line_no") < end)
    text = F.col("value")
    kind = F.when(text.startswith("-"), "report").when(text.startswith("d "), "delete").otherwise("insert")
    parts = F.split(text, " +")
    cut = F.instr(text, "|")
    return rows.select(
        "line_no", kind.alias("kind"),
        F.when(kind == "delete", F.try_element_at(parts, F.lit(2)).cast("int")).when(kind == "insert", F.substring(text, F.lit(1), cut - 1).cast("int")).alias("sid"),
        F.when(kind == "delete", F.try_element_at(parts, F.lit(3)).cast("long")).alias("n"),
        F.when(kind == "insert", F.substr(text, cut + 1)).alias("payload"),
    )


def parse_rows(log: DataFrame, sid: int, schema: T.StructType, sep: str = ",", null_as_zero: bool = False, widths: dict[str, int] | None = None) -> DataFrame:
    """The inserted rows of a stream, with line_no. Extra columns are dropped, missing ones are null.

    null_as_zero: missing and empty numbers become 0, as replays of inputs without nulls need.
    widths: texts of more than so many bytes are cut to as many, less a character that the cut goes through.
    """
    text = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    own = log.filter((F.col("kind") == "insert") & (F.col("sid") == sid))
    parsed = own.select("line_no", F.from_csv("payload", text, {"mode": "PERMISSIVE", "sep": sep, "quote": '"'}).alias("r"))

    def column(f: T.StructField) -> Column:
        c = F.col(f"r.`{f.name}`")
        if null_as_zero and not isinstance(f.dataType, (T.StringType, T.DateType)):
            c = F.coalesce(c, F.lit(0).cast(f.dataType))
        if widths and f.name in widths and isinstance(f.dataType, T.StringType):
            c = cut_bytes(c, widths[f.name])
        return c.alias(f.name)

    return parsed.select("line_no", *map(column, schema.fields))


def cut_bytes(c: Column, most: int) -> Column:
    """A text's longest beginning of at most so many bytes of UTF-8."""
    head = F.substring(c.cast("binary"), 1, most)
    # Bytes that begin a character (all but 10xxxxxx) tell where the last one starts; it stays if it is whole, as when the text ends there.
    whole = F.make_valid_utf8(head.cast("string"))
    return F.when(F.octet_length(c) <= most, c).otherwise(F.regexp_replace(whole, "\ufffd+$", ""))


def read_dat(spark: SparkSession, path: str, schema: T.StructType, time: int = 1) -> DataFrame:
    """A bar-delimited table, with a constant time before its columns; further columns of the file are not read."""
    fields = [f for f in schema.fields if f.name != "time"]
    rows = spark.read.csv(path, sep="|", schema=T.StructType([T.StructField(f.name, f.dataType) for f in fields]), mode="PERMISSIVE")
    return rows.select(F.lit(time).cast("long").alias("time"), *[f.name for f in fields])


def csv_of(df: DataFrame) -> Column:
    """A row as a payload: texts in quotes, nulls empty."""
    parts = [F.concat(F.lit('"'), F.coalesce(F.col(f.name), F.lit("")), F.lit('"')) if isinstance(f.dataType, T.StringType) else F.coalesce(F.col(f.name).cast("string"), F.lit("")) for f in df.schema.fields]
    return F.concat_ws(",", *parts)


def write_lines(lines: DataFrame, path: str, order: list[str], value: str = "value") -> None:
    """Lines as text files whose names follow their order; each task writes one range of it."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select(value).write.mode("overwrite").text(path)
