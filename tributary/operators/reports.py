"""Reports over a log of inserts, deletes and markers: what was live, and what had been produced, at each marker.

No result is made for this. The number of live results is a function of time that changes with single rows, and so are the
weights that make it up: by join key, a table tells its parent at which times its weight changes and by how much. The
product of two such functions changes where either does. So one pass from the leaves of the join tree to its root gives the
changes of the number of live results: with deletes, with windows, and for all markers at once. Increases at inserts add up
to what has been produced.

Time counts the lines that matter, which are markers, deletes and lines at which rows leave a window; what happens
between two of these is one step. Without deletes and windows there are thus as many steps as reports, whatever the log's length.

A row leaves a sliding or tumbling window at the line whose time is beyond it. Rows may come late: one that finds
its window over takes part in nothing; any other counts by its own time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.operators.bandjoin import band_join
from tributary.operators.filters import filtered
from tributary.operators.tables import EACH, arrival, floor_div, keep, running, running_by, step_of
from tributary.operators.weights import WEIGHT, cell, edge_columns, group_rows, key_columns
from tributary.operators.windows import bounds
from tributary.plans.planner import Node, plan
from tributary.plans.spec import Spec, WindowSpec

CHUNK = 4096
FAR = (1 << 63) - 1
BORN, DIES = "_born", "_gone"


def lifetimes(rows: DataFrame, deletes: DataFrame) -> DataFrame:
    """rows (line_no, ...) with _dies: the line of the delete that takes the row, or null.

    deletes: (line_no, n); each pops the n oldest of the rows stored by then, or all of them. After delete i as many are
    gone as min(stored_i, gone before + n_i); unrolled, that is N_i + min(0, min over j <= i of stored_j - N_j), with N
    the running sum of n. Row k dies by the first delete with more than k gone.
    """
    step = step_of(rows.select("line_no").unionByName(deletes.select("line_no")), "line_no")
    indexed = arrival(rows, [], "line_no", step)
    events = rows.select("line_no", F.lit(1).alias("one"), F.lit(None).cast("long").alias("n")).unionByName(deletes.select("line_no", F.lit(0).alias("one"), F.col("n").cast("long").alias("n")))
    cuts = running(events, "line_no", F.col("one"), "stored", step=step).filter("n IS NOT NULL")
    cuts = running(cuts, "line_no", F.col("n"), "asked", step=step)
    cuts = running(cuts, "line_no", F.col("stored") - F.col("asked"), "short", "min", step)
    cuts = cuts.select(F.col("line_no").alias("_dies"), (F.col("asked") + F.least(F.lit(0), F.col("short"))).alias("upto"))
    # Deletes that take rows, with the span of row numbers that each takes; spans meet rows by chunks of numbers.
    firsts = cuts.groupBy("upto").agg(F.min("_dies").alias("_dies")).withColumn("_piece", F.shiftright("upto", 24))
    ends = firsts.groupBy("_piece").agg(F.max("upto").alias("_end")).withColumn("_last", F.max("_end").over(W.orderBy("_piece").rowsBetween(W.unboundedPreceding, -1))).drop("_end")
    since = F.coalesce(F.lag("upto").over(W.partitionBy("_piece").orderBy("upto")), "_last", F.lit(0))
    spans = firsts.join(ends, "_piece").withColumn("since", since).filter("upto > since")
    spans = spans.withColumn("_c", F.explode(F.sequence(floor_div(F.col("since"), CHUNK), floor_div(F.col("upto") - 1, CHUNK)))).select("_c", "since", "upto", "_dies")
    own = indexed.withColumn("_k", floor_div(F.col("_idx"), CHUNK))
    within = (own["_k"] == spans["_c"]) & (own["_idx"] >= spans["since"]) & (own["_idx"] < spans["upto"])
    return own.join(spans, within, "left").drop("_c", "_k", "_idx", "since", "upto")


def alive(spec: Spec, rows: dict[str, DataFrame], at: int) -> Spec:
    """The query over the rows that are stored at a line; rows: each stream's table with line_no and _dies."""
    stored = (F.col("line_no") < at) & (F.col("_dies").isNull() | (F.col("_dies") > at))
    return spec.over({n: rows[n].filter(stored) for n in spec.streams})


def clock(spec: Spec, rows: dict[str, DataFrame], marks: DataFrame) -> DataFrame:
    """(line_no, top, mark): of every row and marker, the latest time of rows up to it."""
    every = marks.select("line_no", F.lit(None).cast("long").alias("ts"), F.lit(True).alias("mark"))
    for n, s in spec.streams.items():
        every = every.unionByName(rows[n].select("line_no", F.col(s.ts).alias("ts"), F.lit(False).alias("mark")))
    return keep(running(every, "line_no", F.col("ts"), "top", "max").select("line_no", "top", "mark"), "clock")


def expired(spec: Spec, rows: dict[str, DataFrame], tops: DataFrame) -> dict[str, DataFrame]:
    """rows whose _dies is also the first line whose time is beyond their window; tops: of clock()."""
    size = spec.window.size

    def limit(ts: str):
        return F.col(ts) + size if spec.window.kind == "sliding" else (floor_div(F.col(ts), size) + 1) * size

    # A record is a line that sets the clock forward. In the order of falling times the least line so far is the first at or beyond a time.
    records = tops.filter("top IS NOT NULL").groupBy("top").agg(F.min("line_no").alias("line_no")).select((-2 * F.col("top")).alias("o"), "line_no")
    asked = None
    for n, s in spec.streams.items():
        own = rows[n].select(limit(s.ts).alias("limit")).distinct()
        asked = own if asked is None else asked.unionByName(own)
    asked = asked.filter("limit IS NOT NULL").distinct().select((1 - 2 * F.col("limit")).alias("o"), F.lit(None).cast("long").alias("line_no"))
    first = running(records.unionByName(asked), "o", F.col("line_no"), "over", "min").filter("line_no IS NULL AND over IS NOT NULL")
    first = keep(first.select(floor_div(1 - F.col("o"), 2).alias("_limit"), "over"), "over")
    out = {}
    for n, s in spec.streams.items():
        met = rows[n].withColumn("_limit", limit(s.ts)).join(first, "_limit", "left")
        out[n] = met.withColumn("_dies", F.least("_dies", "over")).drop("_limit", "over")
    return out


#: Up to so many markers, in a log where nothing else ends a step, rows find theirs by comparing.
FEW = 64


def passed(rows: DataFrame, stops: DataFrame, few: list[int] | None, step: tuple[int, int] | None) -> DataFrame:
    """rows with _passed: how many stops come before a row's line. few: the stops, if they are so few; step: of step_of(), for twice the lines."""
    if few is not None:
        counted = sum((F.when(F.col("line_no") >= m, 1).otherwise(0) for m in few[1:]), F.when(F.col("line_no") >= few[0], 1).otherwise(0))
        return rows.withColumn("_passed", counted.cast("long"))
    marked = rows.withColumn("_at", 2 * F.col("line_no") + 1).withColumn("_stop", F.lit(0)).unionByName(stops.select((2 * F.col("line_no")).alias("_at"), F.lit(1).alias("_stop")), allowMissingColumns=True)
    return running(marked, "_at", F.col("_stop"), "_passed", step=step).filter("_stop = 0").drop("_at", "_stop")


def timed(rows: dict[str, DataFrame], stops: DataFrame, few: list[int] | None, step: tuple[int, int] | None) -> dict[str, DataFrame]:
    """rows with the steps at which they come, _born, and go, _gone (FAR: never). stops: (line_no, rank), the lines that end a step.

    At stop j rows go, at step 2j; what comes after it, up to the next stop, comes at step 2j + 1. Rows that never were have _gone before _born.
    """
    ranks = stops.select(F.col("line_no").alias("_key"), (2 * F.col("rank")).alias(DIES))
    out = {}
    for n, df in rows.items():
        placed = passed(df, stops, few, step).withColumn(BORN, 2 * F.col("_passed") + 1)
        if few is not None:  # nothing goes
            out[n] = placed.withColumn(DIES, F.lit(FAR)).drop("_passed")
            continue
        # Rows that never go have keys of their own, which spread them and meet nothing.
        met = placed.withColumn("_key", F.coalesce("_dies", -1 - F.col("line_no"))).join(ranks, "_key", "left")
        out[n] = met.withColumn(DIES, F.when(F.col("_dies") <= F.col("line_no"), 0).otherwise(F.coalesce(DIES, F.lit(FAR)))).drop("_passed", "_key")
    return out


def changes(spec: Spec, node: Node, wanted: dict[str, set[str]]) -> DataFrame:
    """(keys..., _t, _d): by a node's key combinations, at which steps the weight of its live rows changes, and by how much."""
    keys = [c for child in node.children for c in key_columns(child, child.parent_stream)]
    if node.edge:
        keys += key_columns(node, node.stream)
    keys = list(dict.fromkeys(keys))
    rows = group_rows(spec, node.group, {s: c | {BORN, DIES} for s, c in wanted.items()})
    together = lambda f, c: f(*[F.col(cell(m, c)) for m in node.group.members]) if len(node.group.members) > 1 else F.col(cell(node.group.root, c))
    rows = rows.select(*keys, together(F.greatest, BORN).alias("_in"), together(F.least, DIES).alias("_out")).filter("_in < _out")
    both = F.array(F.struct(F.col("_in").alias("t"), F.lit(1).alias("d")), F.struct(F.col("_out").alias("t"), F.lit(-1).alias("d")))
    own = rows.select(*keys, F.explode(both).alias("_e")).select(*keys, F.col("_e.t").alias("_t"), F.col("_e.d").alias("_d")).filter(F.col("_t") < FAR)
    own = own.groupBy(*keys, "_t").agg(F.sum("_d").cast(WEIGHT).alias("_d")).filter("_d != 0")
    if node.children:
        own = keep(own, "changes")
    for child in node.children:
        theirs, mine = key_columns(child, child.stream), key_columns(child, child.parent_stream)
        told = changes(spec, child, wanted).groupBy(*theirs, "_t").agg(F.sum("_d").cast(WEIGHT).alias("_d"))
        combinations = own.select(*keys).distinct()
        if child.edge.is_band:
            met = band_join(own.select(*mine).distinct(), mine[0], told, theirs[0], child.edge.width)
            told = met.groupBy(*mine, "_t").agg(F.sum("_d").cast(WEIGHT).alias("_d"))
        else:
            told = told.withColumnsRenamed(dict(zip(theirs, mine)))
        none = F.lit(0).cast(WEIGHT)
        one = own.select(*keys, "_t", F.col("_d").alias("_f"), none.alias("_g"))
        two = combinations.join(told, mine).select(*keys, "_t", none.alias("_f"), F.col("_d").alias("_g"))
        every = one.unionByName(two).groupBy(*keys, "_t").agg(F.sum("_f").cast(WEIGHT).alias("_f"), F.sum("_g").cast(WEIGHT).alias("_g"))
        sums = running_by(every, keys, "_t", {"_all_f": "_f", "_all_g": "_g"}, WEIGHT)
        step = F.col("_all_f") * F.col("_all_g") - (F.col("_all_f") - F.col("_f")) * (F.col("_all_g") - F.col("_g"))
        own = sums.select(*keys, "_t", step.cast(WEIGHT).alias("_d")).filter("_d != 0")
    return own


def with_lifetimes(spec: Spec, own: dict[str, DataFrame], deletes: DataFrame, sids: dict[int, str]) -> dict[str, DataFrame]:
    """Each stream's stored rows with _dies; own: rows that filters let pass; deletes: (line_no, sid, n)."""
    out = {}
    for sid, n in sids.items():
        mine = deletes.filter(F.col("sid") == sid).select("line_no", "n")
        if mine.limit(1).count():
            out[n] = keep(lifetimes(own[n], mine), "lifetimes")
        else:
            out[n] = own[n].withColumn("_dies", F.lit(None).cast("long"))
    return out


def history(spec: Spec, lived: dict[str, DataFrame], deletes: DataFrame, marks: list[int], use_keys: bool = True) -> list[dict]:
    """For each marker (line numbers, a row a report): live results, results produced and rows so far, and the latest time.

    lived: of with_lifetimes(). Rows so far count inserts, and deletes by the rows that they ask for.
    """
    if not marks:
        return []
    spark = next(iter(lived.values())).sparkSession
    at = spark.createDataFrame([(m,) for m in marks], "line_no long")
    windowed, tops = spec.window.kind != "none", None
    if windowed:
        tops = clock(spec, lived, at)
        lived = expired(spec, lived, tops)
    few = marks if len(marks) <= FEW and not windowed and not deletes.limit(1).count() else None
    step = None
    if few is not None:
        stops = spark.createDataFrame([(m, i + 1) for i, m in enumerate(marks)], "line_no long, rank long")
    else:
        stops = at.unionByName(deletes.select("line_no"))
        for df in lived.values() if windowed else ():
            stops = stops.unionByName(df.filter("_dies IS NOT NULL").select(F.col("_dies").alias("line_no")))
        stops = arrival(stops.distinct(), [], "line_no")
        stops = keep(stops.select("line_no", (F.col("_idx") + 1).cast("long").alias("rank")), "stops")
        lines = None
        for df in lived.values():
            lines = df.select("line_no") if lines is None else lines.unionByName(df.select("line_no"))
        low, each = step_of(lines, "line_no")
        step = (2 * low, 2 * each)
    placed = {n: keep(df, "placed") for n, df in timed(lived, stops, few, step).items()}
    flat = spec.over(placed, WindowSpec())
    flat.filters = []
    top = plan(flat, use_keys)
    live = changes(flat, top, edge_columns(top, flat)).groupBy("_t").agg(F.sum("_d").cast(WEIGHT).alias("d"))
    no_mark, none = F.lit(None).cast("long").alias("mark"), [F.lit(0).cast(WEIGHT).alias("d"), F.lit(0).cast(WEIGHT).alias("p")]
    events = live.select("_t", "d", F.when(F.col("_t") % 2 == 1, F.col("d")).otherwise(F.lit(0)).cast(WEIGHT).alias("p"), F.lit(0).cast("long").alias("n"), no_mark)
    ranked = stops.select("line_no", (2 * F.col("rank")).alias("_t"))
    if few is None:
        events = events.unionByName(deletes.join(ranked, "line_no").select("_t", *none, F.col("n").cast("long").alias("n"), no_mark))
    events = events.unionByName(at.join(ranked, "line_no").select("_t", *none, F.lit(0).cast("long").alias("n"), F.col("line_no").alias("mark")))
    for df in placed.values():
        events = events.unionByName(df.groupBy(F.col(BORN).alias("_t")).agg(F.count("*").alias("n")).select("_t", *none, "n", no_mark))
    # At most two rows a stop, numbered without gaps.
    sums = keep(events.groupBy("_t").agg(*[F.sum(c).alias(c) for c in ("d", "p", "n")], F.max("mark").alias("mark")), "steps")
    for c in ("d", "p", "n"):
        sums = running(sums, "_t", F.col(c), f"all_{c}", step=(0, EACH))
    found = sums.filter("mark IS NOT NULL").select("mark", "all_d", "all_p", "all_n")
    latest = {r["line_no"]: r["top"] for r in tops.filter("mark").collect()} if windowed else {}
    rows = {r["mark"]: r for r in found.collect()}
    return [{"line_no": m, "n_seen": int(rows[m]["all_d"]), "made": int(rows[m]["all_p"]), "tuples": int(rows[m]["all_n"]), "top": latest.get(m)} for m in marks]


def report_rows(spec: Spec, log: DataFrame, rows: dict[str, DataFrame], sids: dict[int, str], sample_size, use_keys: bool = True) -> DataFrame:
    """A row a marker: epoch, n_proc, win_lo, win_hi, n_seen, ssize, ntup; n_proc and ntup since the last marker.

    ntup counts inserts that filters let pass, and deletes by the rows that they ask for. sample_size: from n_seen to ssize.
    """
    own = {n: filtered(rows[n], [f for f in spec.filters if f.stream == n]) for n in spec.streams}
    deletes = log.filter("kind = 'delete'").select("line_no", "sid", "n")
    marks = [r["line_no"] for r in log.filter("kind = 'report'").select("line_no").orderBy("line_no").collect()]  # a row a report
    out, made, tuples = [], 0, 0
    for epoch, h in enumerate(history(spec, with_lifetimes(spec, own, deletes, sids), deletes, marks, use_keys)):
        low, high = bounds(spec.window, h["top"])
        out.append((epoch, h["made"] - made, low, high, h["n_seen"], sample_size(h["n_seen"]), h["tuples"] - tuples))
        made, tuples = h["made"], h["tuples"]
    return log.sparkSession.createDataFrame(out, "epoch int, n_proc long, win_lo long, win_hi long, n_seen long, ssize long, ntup long")
