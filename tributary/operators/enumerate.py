"""The join itself, by a chain of plain joins: for small results, as a base line, and to check the counts.

Where keys have very many pairs, a key's rows are dealt into parts on both sides, and each pair of parts is joined by itself: else
a key's results are all made by one task. What is shuffled for it is in proportion to the rows, and to 1 / PART of the pairs for the
left side and 1 / (PART * TALL) for the right.

The right side's rows come in arrays of CHUNK, and results array by array: its rows over and over in one order, for the part's rows of the
left side one after the other. Parquet compresses pages of 20,000 rows each by itself, so runs as short as that take about half of the bytes
that runs of 2048 rows would, and the left side's dictionaries, one a file, serve all of PART. The left rows of a part are held in memory:
some PART * TALL, or as many as have equal names, or those of a key that isn't dealt, of less than 1 / SMALL of a part's pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.operators.bandjoin import band_join
from tributary.operators.tables import arrival, floor_div, keep
from tributary.operators.weights import WINDOW, cell, stream_rows
from tributary.plans.planner import check
from tributary.plans.spec import Spec, estimated_bytes

#: Rows of an array. Files number a column's values by bits, with a byte before each 504 values, so runs of 504 repeat byte by byte.
CHUNK = 504
#: Rows of a part of a key, about: of the right side PART, a multiple of CHUNK, of the left side TALL times as many. Keys with 1 / SMALL of a part's pairs are dealt.
PART, TALL, SMALL = 16 * CHUNK, 0.25, 32
#: Pairs up to which tables aren't searched for such keys, by the least bytes that a row may have.
FEW, ROW_BYTES = 1 << 28, 8
#: Partitions that parts are dealt to, at most.
MOST = 1 << 13


def most_rows(spec: Spec, streams: set[str]) -> int:
    """Of the largest of some streams, by the planner's estimate."""
    return max(estimated_bytes(spec.streams[s].frame) for s in streams) // ROW_BYTES


def equal(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(Column.__and__, [left[a] == right[b] for a, b in pairs])


def dealt_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], names: tuple[list[str], list[str]], most: int | None) -> DataFrame:
    """left and right where pairs of columns are equal, as a plain join has it, with keys of very many pairs in parts.

    names: of each side, columns that name its rows; these decide the part. most: rows that left has at most, if that is known.
    """
    mine, theirs = [a for a, _ in pairs], [b for _, b in pairs]
    n_theirs = right.groupBy(*theirs).agg(F.count("*").alias("_n"))
    top = n_theirs.filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in theirs])).agg(F.max("_n")).first()[0] or 0
    if top < 2 or (most is not None and top * most < FEW):
        return left.join(right, equal(left, right, pairs))
    n_mine = left.groupBy(*mine).agg(F.count("*").alias("_m"))
    hot = n_mine.join(n_theirs, equal(n_mine, n_theirs, pairs)).filter(F.col("_m").cast("double") * F.col("_n") >= PART * PART * TALL / SMALL)
    hot = hot.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(theirs)], F.ceil(F.col("_m") / (PART * TALL)).cast("int").alias("_ms"), F.ceil(F.col("_n") / PART).cast("int").alias("_ns"))
    hot = keep(hot, "hot")
    cells = hot.agg(F.sum(F.col("_ms").cast("double") * F.col("_ns"))).first()[0]
    if not cells:
        return left.join(right, equal(left, right, pairs))

    def dealt(side: DataFrame, keys: list[str], part: Column, own: str, other: str) -> DataFrame:
        """A row's own part, and all parts of the other side."""
        known = side.join(hot, equal(side, hot, [(c, f"_k{i}") for i, c in enumerate(keys)]), "left")
        return known.select(*side.columns, part.alias(own), F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"{other}s"), F.lit(1)) - 1)).alias(other))

    numbered = arrival(right.withColumn("_h", F.shiftright(F.xxhash64(*names[1]), 2)), theirs, "_h")
    packed = numbered.withColumn("_c", floor_div(F.col("_idx"), CHUNK)).groupBy(*theirs, "_c").agg(F.collect_list(F.struct(*[c for c in right.columns if c not in theirs])).alias("_rows"))
    n = int(min(MOST, cells + int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    by_hash = F.coalesce(F.pmod(F.xxhash64(*names[0]), F.col("_ms")), F.lit(0)).cast("int")
    by_place = F.when(F.col("_ns").isNull(), 0).otherwise(floor_div(F.col("_c"), max(1, PART // CHUNK))).cast("int")
    ours = dealt(left, mine, by_hash, "_m", "_n").repartition(n, *mine, "_m", "_n")
    others = dealt(packed, theirs, by_place, "_n", "_m").withColumnsRenamed({"_m": "_om", "_n": "_on"}).repartition(n, *theirs, "_om", "_on")
    met = others.hint("merge").join(ours, equal(others, ours, [*[(b, a) for a, b in pairs], ("_om", "_m"), ("_on", "_n")]))  # goes array by array
    return met.select(*left.columns, *theirs, F.inline("_rows"))


def results(spec: Spec) -> DataFrame:
    """A row for each result: <stream>_rid for all streams, and result_ts, the least time, if streams have times.

    Foreign keys are ordinary equalities here. With a sliding window, members lie within its size of each other.
    """
    check(spec)
    timed = all(s.ts for s in spec.streams.values())
    windowed = spec.window.kind == "tumbling"
    needed = {s: ({spec.streams[s].ts} if timed else set()) for s in spec.streams}
    for e in spec.edges:
        needed[e.left].update(e.left_cols)
        needed[e.right].update(e.right_cols)

    def own(name: str) -> DataFrame:
        rows = stream_rows(spec, name, needed[name], True)
        return rows.withColumnRenamed(WINDOW, cell(name, WINDOW)) if windowed else rows

    first = next(iter(spec.streams))
    joined, left, done, found = own(first), list(spec.edges), {first}, True
    while left:
        edge = next(e for e in left if (e.left in done) != (e.right in done))
        left.remove(edge)
        old = edge.left if edge.left in done else edge.right
        new = edge.other(old)
        other = own(new)
        also = [(cell(old, WINDOW), cell(new, WINDOW))] if windowed else []
        pairs = [(cell(old, a), cell(new, b)) for a, b in zip(edge.cols(old), edge.cols(new))]
        if edge.is_band:
            joined, found = band_join(joined, *pairs[0][:1], other, pairs[0][1], edge.width, also), False
        else:
            # left has a row for each of a stream's at most, as long as all others were found by their keys
            most = most_rows(spec, done) if found else None
            by_key = edge.foreign_key == old
            found = found and by_key
            if by_key or (most is not None and most * most_rows(spec, {new}) < FEW):
                joined = joined.join(other, equal(joined, other, [*pairs, *also]))
            else:
                named = [cell(s, "_rid") for s in spec.streams if s in done], [cell(new, "_rid")]
                joined = dealt_join(joined, other, [*pairs, *also], named, most)
        done.add(new)
    times = [F.col(cell(s, spec.streams[s].ts)) for s in spec.streams] if timed else []
    extreme = lambda f: f(*times) if len(times) > 1 else times[0]
    if spec.window.kind == "sliding":
        joined = joined.filter(extreme(F.greatest) - extreme(F.least) <= spec.window.size - 1)
    out = [F.col(cell(s, "_rid")).alias(f"{s}_rid") for s in spec.streams]
    if timed:
        out += [extreme(F.least).alias("result_ts"), extreme(F.greatest).alias("last_ts")]
    return joined.select(*out)
