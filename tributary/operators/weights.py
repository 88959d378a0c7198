"""Result counts without results: weights from the leaves of the join tree to its root.

The weight of a row is the number of join results that its subtree gives it: the product over child tables of the
summed weights of matching rows. Rows with equal join keys are grouped before anything is joined, so
what is shuffled is at most a row for each distinct combination of keys and task, and a hot key costs one row.
Sums are decimal(38, 0): exact, and an overflow is an error.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.operators.bandjoin import band_sums, bin_of
from tributary.operators.filters import filtered
from tributary.operators.tables import floor_div, keep, rid
from tributary.plans.planner import Group, Node
from tributary.plans.spec import Spec, estimated_bytes

WEIGHT = "decimal(38,0)"
#: Bytes of a table, by the planner's estimate, up to which sums over it are not worth writing.
SMALL = 8 << 20
WINDOW = "_window"


def cell(stream: str, column: str) -> str:
    """The name of a stream's column beside others'."""
    return f"{stream}__{column}"


def window_id(spec: Spec, stream: str) -> Column | None:
    """Tumbling windows are one more column that all streams must agree on."""
    if spec.window.kind != "tumbling":
        return None
    return floor_div(F.col(spec.streams[stream].ts), spec.window.size)


def stream_rows(spec: Spec, name: str, columns: set[str], with_rid: bool, also: tuple[Column, ...] = ()) -> DataFrame:
    """A stream's filtered rows: the columns asked for, its window and its row name, and `also` what is made of its columns."""
    stream = spec.streams[name]
    out = [F.col(c).alias(cell(name, c)) for c in sorted(columns)] + list(also)
    if (w := window_id(spec, name)) is not None:
        out.append(w.alias(WINDOW))
    if with_rid:
        out.append(rid(stream).alias(cell(name, "_rid")))
    return filtered(stream.frame, [f for f in spec.filters if f.stream == name]).select(*out)


def edge_columns(top: Node, spec: Spec) -> dict[str, set[str]]:
    """Of each stream, the columns that unfolded edges need."""
    out: dict[str, set[str]] = {s: set() for s in spec.streams}
    for node in top.walk():
        if node.edge:
            out[node.stream].update(node.edge.cols(node.stream))
            out[node.parent_stream].update(node.edge.cols(node.parent_stream))
    return out


def group_rows(spec: Spec, group: Group, wanted: dict[str, set[str]], trust_keys: bool = False, rids: set[str] = frozenset(), counted: bool = False, also: tuple[Column, ...] = ()) -> DataFrame:
    """A group as one table: its root's rows with what its keys lead to, and `also` what is made of the root's columns.

    A folded stream that gives no column is a semi-join; with trust_keys it is left out, unless it has a filter
    or bears a window, since each reference then has exactly one target. counted: rows only matter by their number, _n.
    Then, wherever the next join needs a single column, equal rows are added up before it; the join finds them
    distributed by that column already, and what it passes on has at most a row a key.
    """
    below: dict[str, set[str]] = {m: set(wanted[m]) for m in group.members}
    for child, parent, edge in group.folded:
        below[parent].update(edge.cols(parent))
    windowed = spec.window.kind == "tumbling"
    used: set[str] = set()  # streams that give columns, or lead to one that does
    for child, parent, _ in reversed(group.folded):
        own = wanted[child] or child in rids or child in used
        tested = any(f.stream == child for f in spec.filters) or windowed
        if own:
            used.update((child, parent))
        elif tested or not trust_keys or child in used:
            used.add(f"?{child}")
            if parent != group.root:
                used.add(parent)
    order = spec.key_order
    rows = stream_rows(spec, group.root, below[group.root] | wanted[group.root] | ({order} if order and group.folded else set()), group.root in rids, also)
    steps = [f for f in group.folded if f[0] in used or f"?{f[0]}" in used]
    joined = {group.root}
    if counted:
        rows = rows.withColumn("_n", F.lit(1).cast("long"))
    for i, (child, parent, edge) in enumerate(steps):
        keys = list(zip(edge.cols(parent), edge.cols(child)))
        columns = (below[child] if child in used else set()) | set(edge.cols(child)) | ({order} if order else set())
        own = stream_rows(spec, child, columns, child in rids)
        if spec.first_key_wins:
            own = first_of_key(own, [cell(child, c) for _, c in keys], cell(child, order) if order else None)
        if windowed:
            own = own.withColumnRenamed(WINDOW, "_w2")
        if counted and not windowed and not order:
            still = {cell(m, c) for m in joined for c in wanted[m]} | {cell(p, c) for _, p, e in steps[i:] if p in joined for c in e.cols(p)}
            if len(still) == 1:
                rows = rows.groupBy(*still).agg(F.sum("_n").alias("_n"))
        on = reduce(Column.__and__, [rows[cell(parent, p)] == own[cell(child, c)] for p, c in keys])
        if windowed:
            on = on & (rows[WINDOW] == own["_w2"])
        if order:  # looked up when the root's row arrives
            on = on & (own[cell(child, order)] < rows[cell(group.root, order)])
        rows = rows.join(own, on, "inner" if child in used else "left_semi").drop("_w2")
        if child in used:
            joined.add(child)
    return rows


def first_of_key(rows: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row of each key: the first by order, or else the least; combined before it is shuffled."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    first = F.min(F.struct(*([order] if order else []), *[c for c in rest if c != order])).alias("_first")
    return rows.groupBy(*keys).agg(first).select(*keys, *[F.col("_first").getField(c).alias(c) for c in rest])


def key_problems(spec: Spec, most: int = 10) -> DataFrame:
    """(problem, stream, key): of each foreign key, up to `most` keys that occur twice, and that references miss."""
    out = None
    for edge in spec.edges:
        if not edge.foreign_key:
            continue
        parent, child = edge.foreign_key, edge.other(edge.foreign_key)
        text = lambda s: F.concat_ws("|", *[F.col(cell(s, c)).cast("string") for c in edge.cols(s)]).alias("key")  # noqa: B023, E731
        have = stream_rows(spec, child, set(edge.cols(child)), False).select(text(child)).groupBy("key").count()
        twice = have.filter("count > 1").select(F.lit("duplicate").alias("problem"), F.lit(child).alias("stream"), "key").limit(most)
        asked = stream_rows(spec, parent, set(edge.cols(parent)), False).select(text(parent)).distinct()
        missed = asked.join(have, "key", "left_anti").select(F.lit("missing").alias("problem"), F.lit(parent).alias("stream"), "key").limit(most)
        part = twice.unionByName(missed)
        out = part if out is None else out.unionByName(part)
    if out is None:
        spark = next(iter(spec.streams.values())).frame.sparkSession
        out = spark.createDataFrame([], "problem string, stream string, key string")
    return out


def key_columns(node: Node, stream: str) -> list[str]:
    return [cell(stream, c) for c in node.edge.cols(stream)]


def message(spec: Spec, node: Node, weighted: DataFrame, windowed: list[str]) -> DataFrame:
    """What a node tells its parent: by its key (and window), the sum of weights, as _m."""
    return weighted.groupBy(*key_columns(node, node.stream), *windowed).agg(F.sum("_w").cast(WEIGHT).alias("_m"))


def for_parent(node: Node, keys: DataFrame, told: DataFrame, windowed: list[str]) -> DataFrame:
    """A message by the parent's key columns. keys: the parent's distinct keys, which only bands look at.

    Over a band, each distinct key of the parent sums up the child's keys once.
    """
    theirs, mine = key_columns(node, node.stream), key_columns(node, node.parent_stream)
    if not node.edge.is_band:
        return told.withColumnsRenamed(dict(zip(theirs, mine)))
    also = [(w, f"_c{w}") for w in windowed]
    told = told.withColumnsRenamed(dict(also))
    return band_sums(keys, mine[0], told, theirs[0], node.edge.width, also).select(*mine, *windowed, "_m")


def take_message(node: Node, rows: DataFrame, taken: DataFrame, windowed: list[str], name: str) -> DataFrame:
    """Parent's rows with the child's sums for them in column `name`; rows without a match go."""
    return rows.join(taken.withColumnRenamed("_m", name), [*key_columns(node, node.parent_stream), *windowed])


def weigh(spec: Spec, node: Node, wanted: dict[str, set[str]], trust_keys: bool, kept: dict[int, Told] | None = None, near: bool = False) -> DataFrame:
    """A node's distinct key combinations with their number times their subtrees' results, as _w.

    kept: gets what each child tells, written, so that later steps share it. near: tables below keep only rows whose keys
    this node's rows have, which pays where it has few.
    """
    windowed = [WINDOW] if spec.window.kind == "tumbling" else []
    keys = [c for child in node.children for c in key_columns(child, child.parent_stream)]
    if node.edge:
        keys += key_columns(node, node.stream)
    keys = list(dict.fromkeys(keys)) + windowed
    rows = group_rows(spec, node.group, wanted, trust_keys, counted=True).groupBy(*keys).agg(F.sum("_n").cast(WEIGHT).alias("_w"))
    for i, child in enumerate(node.children):
        mine = rows.select(*key_columns(child, child.parent_stream), *windowed).distinct()
        below = asked_for(spec, child, mine) if near else spec
        told = message(spec, child, weigh(below, child, wanted, trust_keys, kept, near), windowed)
        if kept is not None:
            told = keep(told, "told")
        taken = for_parent(child, mine, told, windowed)
        if kept is not None:
            taken = keep(taken, "taken") if child.edge.is_band else taken
            kept[id(child)] = Told(told, taken)
        rows = take_message(child, rows, taken, windowed, f"_m{i}")
        rows = rows.withColumn("_w", (F.col("_w") * F.col(f"_m{i}")).cast(WEIGHT)).drop(f"_m{i}")
    return rows


def asked_for(spec: Spec, child: Node, mine: DataFrame) -> Spec:
    """The query over only those rows of a child's table whose key, or a key in whose band, is among the parent's."""
    s, theirs = spec.streams[child.stream], child.edge.cols(child.stream)
    if not child.edge.is_band:
        keys = mine.select(*key_columns(child, child.parent_stream)).distinct().toDF(*[f"_asked{i}" for i in range(len(theirs))])
        on = reduce(Column.__and__, [s.frame[c] == keys[f"_asked{i}"] for i, c in enumerate(theirs)])
    else:  # by bins of the band: more rows than needed, but few
        width, size = child.edge.width, 2 * child.edge.width + 1
        k = F.col(key_columns(child, child.parent_stream)[0])
        keys = mine.select(F.explode(F.array(bin_of(k - width, size), bin_of(k + width, size))).alias("_asked")).distinct()
        on = bin_of(s.frame[theirs[0]], size) == keys["_asked"]
    return spec.over({child.stream: s.frame.join(keys, on, "left_semi")})


@dataclass
class Told:
    """What a child tells: by its own key, and by its parent's."""

    raw: DataFrame
    taken: DataFrame


def messages(spec: Spec, top: Node, wanted: dict[str, set[str]], near: bool = False) -> dict[int, Told]:
    """What every node below the root tells, by id() of the node; each table is written once. near: see weigh()."""
    kept: dict[int, Told] = {}
    windowed = [WINDOW] if spec.window.kind == "tumbling" else []
    for child in top.children:
        mine = None
        if near or child.edge.is_band:
            mine = group_rows(spec, top.group, wanted).select(*key_columns(child, child.parent_stream), *windowed).distinct()
        below = asked_for(spec, child, mine) if near else spec
        told = message(spec, child, weigh(below, child, wanted, False, kept, near), windowed)
        # A leaf's sums over a small table are as soon made again as written and read.
        told = told if not child.children and estimated_bytes(spec.streams[child.stream].frame) < SMALL else keep(told, "told")
        taken = for_parent(child, mine, told, windowed)
        kept[id(child)] = Told(told, keep(taken, "taken") if child.edge.is_band else taken)
    return kept


def total(spec: Spec, top: Node, trust_keys: bool = False, near: bool = False) -> DataFrame:
    """One row n_seen: the number of results; in tumbling windows, a row (window, n_seen) for each with results."""
    weighted = weigh(spec, top, edge_columns(top, spec), trust_keys, near=near)
    if spec.window.kind == "tumbling":
        return weighted.groupBy(F.col(WINDOW).alias("window")).agg(F.sum("_w").cast(WEIGHT).alias("n_seen"))
    return weighted.agg(F.coalesce(F.sum("_w"), F.lit(0)).cast(WEIGHT).alias("n_seen"))


def row_weights(spec: Spec, top: Node) -> DataFrame:
    """Rows of the root group that have results: the root's row name, and weight."""
    windowed = [WINDOW] if spec.window.kind == "tumbling" else []
    wanted = edge_columns(top, spec)
    rows = group_rows(spec, top.group, wanted, rids={top.group.root}).withColumn("_w", F.lit(1).cast(WEIGHT))
    told = messages(spec, top, wanted)
    for i, child in enumerate(top.children):
        rows = take_message(child, rows, told[id(child)].taken, windowed, f"_m{i}")
        rows = rows.withColumn("_w", (F.col("_w") * F.col(f"_m{i}")).cast(WEIGHT))
    return rows
