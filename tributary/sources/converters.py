"""From data sets to tagged lines: (line_no, value) tables in arrival order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.operators.tables import HASH_BITS, arrival, bucket_bits, floor_div, hash60, keep, running
from tributary.sources.tagged import csv_of

#: Fixed values of the workloads: a report every so many lines; deletes of so many rows after so many inserts.
REPORT_EVERY = 50_000
QY_DELETES = {0: (3000, 600), 1: (500, 100)}


def linear_road(reports: DataFrame, direction: int, min_lane: int, max_lane: int, kind: str = "F", param: int = 60, seed: int = 1) -> DataFrame:
    """Position reports of one direction's lanes, a stream a lane, in the order of line_no.

    reports: line_no, value and the parsed columns type, dir, lane, time. A report marker comes before the row that
    enters a new interval of `param` time units (kind F), or before any row with a chance of 1 in `param` (P), and last.
    """
    own = reports.filter((F.col("type") == 0) & (F.col("dir") == direction) & F.col("lane").between(min_lane, max_lane))
    rows = own.select("line_no", F.concat((F.col("lane") - min_lane).cast("string"), F.lit("|"), F.col("value")).alias("value"), floor_div(F.col("time"), param).alias("_at"))
    if kind == "F":
        # The highest interval up to the row before: lines and what they reach, one line later.
        known = rows.select("line_no", "_at", F.lit(True).alias("_own")).unionByName(rows.select((F.col("line_no") + 1).alias("line_no"), "_at", F.lit(False).alias("_own")))
        reached = known.groupBy("line_no").agg(F.max(F.when(~F.col("_own"), F.col("_at"))).alias("_earlier"), F.max(F.when(F.col("_own"), F.col("_at"))).alias("_at"))
        ranged = running(reached, "line_no", F.col("_earlier"), "_reached", "max").filter("_at IS NOT NULL").select("line_no", F.greatest(F.lit(0).cast("long"), F.coalesce("_reached", F.lit(0))).alias("_prior"))
        ranged = rows.join(ranged, "line_no")
        marked = ranged.withColumn("_mark", F.col("_at") > F.col("_prior"))
    else:
        marked = rows.withColumn("_mark", hash60(F.concat_ws("|", F.lit(str(seed)), F.col("line_no").cast("string"))) % param == 0)
    marks = marked.filter("_mark").select((F.col("line_no") * 2).alias("line_no"), F.lit("-").alias("value"))
    last = own.agg((F.max("line_no") * 2 + 2).alias("line_no")).select(F.coalesce("line_no", F.lit(0)).alias("line_no"), F.lit("-").alias("value"))
    return marked.select((F.col("line_no") * 2 + 1).alias("line_no"), "value").unionByName(marks).unionByName(last)


def place(seed: int, sid: int, csv: Column) -> Column:
    """A row's place in a random order, from the seed, its stream and its text: 60 bits, which SQL elsewhere can repeat."""
    return hash60(F.concat_ws("|", F.lit(str(seed)), F.lit(str(sid)), csv))


def interleave(first: list[tuple[int, DataFrame]], mixed: list[tuple[int, DataFrame]], seed: int, after: tuple[int, list[str], int, list[str]] | None = None, deletes: dict[int, tuple[int, int]] | None = None, report_every: int = REPORT_EVERY) -> DataFrame:
    """Lines of `first` streams, one stream after the other, then of `mixed` streams in random order.

    The order is by a hash of the seed, the stream and the row's text, so it is the same whenever it is made, and in SQL.
    after: (child, columns, parent, columns): a child's row comes after the parent's row that it refers to; if its own
    place is before that, it follows it at once.
    deletes: of a stream, after every so many inserts of mixed rows, so many deletes. A report marker precedes every
    report_every-th row, the first included.

    Lines are numbered by ranges of their places, as many as the table's size asks for; no task orders more than a range of a stream.
    """
    frames, parts = dict(mixed), []
    placed = {sid: df.withColumn("_csv", csv_of(df)).withColumn("_place", place(seed, sid, F.col("_csv"))) for sid, df in [*first, *mixed]}
    for block, (sid, _) in enumerate(first):
        parts.append(placed[sid].select(F.lit(block).alias("block"), F.lit(sid).alias("sid"), F.col("_csv").alias("csv"), F.col("_place").alias("key"), F.lit(0).alias("late"), F.col("_place").alias("tie")))
    for sid in frames:
        rows = placed[sid].withColumn("_key", F.col("_place")).withColumn("_late", F.lit(0))
        if after and after[0] == sid:
            parents = placed[after[2]].select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(after[3])], F.col("_place").alias("_pk"))
            on = [rows[c] == parents[f"_p{i}"] for i, c in enumerate(after[1])]
            met = rows.join(parents, on)
            rows = met.withColumn("_late", (F.col("_pk") >= F.col("_place")).cast("int")).withColumn("_key", F.greatest("_place", "_pk"))
        parts.append(rows.select(F.lit(len(first)).alias("block"), F.lit(sid).alias("sid"), F.col("_csv").alias("csv"), F.col("_key").alias("key"), F.col("_late").alias("late"), F.col("_place").alias("tie")))
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    lines = keep(lines, "lines")
    bits = bucket_bits(lines)
    # Blocks follow each other; in each, ranges of places are the hash's first bits. Equal lines are interchangeable.
    ranged = lines.withColumn("_r", F.shiftright("key", HASH_BITS - bits))
    counts = ranged.groupBy("block", "_r").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("block", "_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy("block", "_r").orderBy("key", "late", "tie", "sid", "csv")) - 1
    numbered = ranged.join(before, ["block", "_r"]).select((F.col("_before") + inside).alias("_n"), "block", "sid", "csv")
    numbered = keep(numbered, "numbered")
    rows = numbered.select((F.col("_n") * 4 + 1).alias("line_no"), F.concat(F.col("sid").cast("string"), F.lit("|"), F.col("csv")).alias("value"))
    marks = numbered.filter(F.col("_n") % report_every == 0).select((F.col("_n") * 4).alias("line_no"), F.lit("-").alias("value"))
    out = rows.unionByName(marks)
    for sid, (every, n) in (deletes or {}).items():
        own = arrival(numbered.filter((F.col("sid") == sid) & (F.col("block") == len(first))), [], "_n")
        out = out.unionByName(own.filter((F.col("_idx") + 1) % every == 0).select((F.col("_n") * 4 + 2).alias("line_no"), F.lit(f"d {sid} {n}").alias("value")))
    return out


def with_pair_key(df: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """A composite key as one whole number: the left column in the upper bits."""
    return df.withColumn(name, F.shiftleft(F.col(left), 32) + F.col(right))


def qx_lines(store_returns: DataFrame, catalog_sales: DataFrame, date_dim: DataFrame, store_sales: DataFrame, seed: int) -> DataFrame:
    """Streams 0 store_returns, 1 catalog_sales, 2 and 3 date_dim, 4 store_sales; a return comes after its sale."""
    key = "item_sk_and_ticket_number"
    return interleave([(2, date_dim), (3, date_dim)], [(4, store_sales), (0, store_returns), (1, catalog_sales)], seed, after=(0, [key], 4, [key]))


def qy_lines(store_sales: DataFrame, customer: DataFrame, demographics: DataFrame, seed: int, deletes: bool = False) -> DataFrame:
    """Streams 0 store_sales, 1 and 4 customer, 2 and 3 household_demographics."""
    return interleave([(2, demographics), (3, demographics), (4, customer)], [(1, customer), (0, store_sales)], seed, deletes=QY_DELETES if deletes else None)


def qz_lines(store_sales: DataFrame, customer: DataFrame, item: DataFrame, demographics: DataFrame, seed: int) -> DataFrame:
    """Streams 0 store_sales, 1 and 5 customer, 2 and 6 item, 3 and 4 household_demographics."""
    return interleave([(3, demographics), (4, demographics), (6, item), (5, customer)], [(1, customer), (2, item), (0, store_sales)], seed)


def edgar(log: DataFrame, octets: DataFrame) -> DataFrame:
    """Access-log rows, each to streams 0, 1 and 2 with a time 0, 1 and 2 seconds later: (line_no, sid, ts, ip, ip24, ...).

    log: line_no, ip with an obfuscated last part, date, time and more; octets: (code, octet), the number of each code.
    """
    parts = F.split("ip", "\\.")
    number = lambda i: F.element_at(parts, i).cast("long")
    met = log.join(octets, F.element_at(parts, 4) == octets["code"]).drop("code")
    ip24 = number(1) * F.lit(1 << 16) + number(2) * F.lit(1 << 8) + number(3)
    base = F.unix_timestamp(F.concat_ws(" ", F.col("date").cast("string"), F.col("time")))
    wide = met.withColumn("ip24", ip24.cast("int")).withColumn("ip", ip24 * F.lit(256) + F.col("octet")).withColumn("original_ts", base).drop("octet")
    return wide.withColumn("sid", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("ts", F.col("original_ts") + F.col("sid"))
