"""The text form of reports and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report_line(n_proc, low, high, n_seen, ssize, ntup) -> str:
    """One report; the window is empty in queries without one."""
    window = f"window [{low}, {high}], " if low is not None else ""
    return f"n_proc = {n_proc}, {window}n_seen  = {n_seen}, ssize = {ssize}, ntup = {ntup}"


def sample_lines(sample: DataFrame, rids: list[str], ts: str | None = None) -> DataFrame:
    """(value): a line a sampled result."""
    time: Column = F.concat(F.lit(", ts = "), F.col(ts).cast("string")) if ts else F.lit("")
    return sample.select(F.concat(F.lit("sample "), F.col("draw").cast("string"), time, F.lit(": "), F.concat_ws(" ", *rids)).alias("value"))
