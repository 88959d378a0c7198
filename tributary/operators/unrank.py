"""Random access to join results: from a number below the size of the join to the rows of that result.

Results are numbered by root row, then by the children in their order, the last running fastest. Rows of a table come
in the order of a hash of their name and then of the name; under a band, by key first.

A draw goes down the tree: its number is split over the children by their sums, and each part looked up among the
rows with the draw's key. Every lookup first uses sums by bucket (the hash's first bits, as many as the table's size
asks for), and only then rows, of the buckets that draws fall in: other rows leave the table before it is joined with
anything. So no task orders a whole key, however many rows have it. What a node tells its parent is computed once
and shared by all steps.

That is for draws that are few against rows, as each meets all buckets of its key. Of more than MANY draws, as a Bernoulli
sample may have, each is met with its row alone: rows cover ranges of numbers, ranges are cut at bins of about a row's width, and
draws and rows are joined by bin. So the work is in proportion to rows and draws, and no key is one task's load.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.operators.bandjoin import band_join
from tributary.operators.tables import HASH_BITS, bucket_bits, hash60, keep, rid
from tributary.operators.weights import WEIGHT, Told, cell, edge_columns, group_rows, key_columns, messages, take_message
from tributary.plans.planner import Node
from tributary.plans.spec import Spec

#: A table of buckets is broadcast if it has at most 2 ** this rows of a number each.
SMALL_BITS = 18
#: Bins that draws and the root's buckets meet in, at most.
BINS = 1 << 16
#: From so many draws on, they are joined with rows by bins of numbers, at most ROW_BINS to a key's numbers.
MANY, ROW_BINS = 1 << 16, 1 << 22


@dataclass
class Prepared:
    """A query whose results can be had by number: what nodes tell, the root's sums by bucket, and the size."""

    spec: Spec
    top: Node
    wanted: dict[str, set[str]]
    told: dict[int, Told]
    bits: dict[str, int]
    sums: DataFrame
    size: int


def positions(p: Prepared, node: Node, near: DataFrame | bool | None = None, columns: dict[str, list[str]] | None = None) -> DataFrame:
    """A node's rows, one by one: keys, _b (bucket), _w and the sums _m0, _m1, ... of its children.

    near: buckets (_b) whose rows are wanted; others leave the table before it is joined with anything. True: all. Rows then have
    _h (the hash of the name) and the names of all members of the group, and their `columns` (by stream).
    """
    spec, root, wanted = p.spec, node.group.root, p.wanted
    s, bits = spec.streams[root], p.bits[root]
    place = hash60(rid(s))
    # Never null, so the planner needs no filter that would work it out a second time.
    bucket = F.coalesce(F.shiftright(place, HASH_BITS - bits).cast("int"), F.lit(0))
    if near is None:
        rows = group_rows(spec, node.group, wanted, also=(bucket.alias("_b"),))
    else:
        placed = s.frame.withColumn("_b", bucket)
        if near is not True:
            placed = placed.join(F.broadcast(near) if bits <= SMALL_BITS else near, "_b", "left_semi")
        spec = spec.over({root: placed})
        wide = {m: wanted[m] | set((columns or {}).get(m, ())) for m in wanted}
        rows = group_rows(spec, node.group, wide, rids=set(node.group.members), also=(F.col("_b"), place.alias("_h")))
    rows = rows.withColumn("_w", F.lit(1).cast(WEIGHT))
    for i, child in enumerate(node.children):
        rows = take_message(child, rows, p.told[id(child)].taken, [], f"_m{i}")
        rows = rows.withColumn("_w", (F.col("_w") * F.col(f"_m{i}")).cast(WEIGHT))
    return rows


def running(over, order: list[str]) -> Column:
    """The sum of weights before a row."""
    window = W.partitionBy(*over).orderBy(*order) if over else W.orderBy(*order)
    return F.coalesce(F.sum("_w").over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast(WEIGHT)


def prepare(spec: Spec, top: Node, near: bool = False) -> Prepared:
    """Weights from the leaves to the root's buckets, once for the size, the numbers and all draws.

    near: other tables take part only with rows whose keys the root's rows have, which pays where the root is small.
    """
    wanted = edge_columns(top, spec)
    bits = {n.group.root: bucket_bits(spec.streams[n.group.root].frame) for n in top.walk()}
    p = Prepared(spec, top, wanted, messages(spec, top, wanted, near), bits, None, 0)
    p.sums = keep(positions(p, top).groupBy("_b").agg(F.sum("_w").cast(WEIGHT).alias("_w"), F.count("*").alias("_n")), "sums")
    p.size = int(p.sums.agg(F.sum("_w")).first()[0] or 0)
    return p


FALLS = "_j >= _lo AND _j < _lo + _w"


def look_up(p: Prepared, node: Node, draws: DataFrame, keys: list[str], columns: dict[str, list[str]]) -> DataFrame:
    """For draws (draw, keys..., _j) the row that number _j falls on, with _x, what is left of it."""
    asked = draws.select(*keys).distinct() if keys else None
    of_keys = lambda rows: rows.join(asked, keys, "left_semi") if keys else rows
    if keys:
        sums = of_keys(positions(p, node)).groupBy(*keys, "_b").agg(F.sum("_w").cast(WEIGHT).alias("_w"))
        at = draws.join(sums.withColumn("_lo", running(keys, ["_b"])), keys).filter(FALLS)
    else:
        at = at_root(draws, p.sums.withColumn("_lo", running([], ["_b"])), p.size)
    at = at.select("draw", *keys, "_b", (F.col("_j") - F.col("_lo")).cast(WEIGHT).alias("_j"))
    if keys:
        at = keep(at, "draws")
    hit = at.select(*keys, "_b").distinct()
    rows = of_keys(positions(p, node, at.select("_b").distinct(), columns)).join(hit, [*keys, "_b"], "left_semi")
    near = rows.withColumn("_lo", running([*keys, "_b"], ["_h", cell(node.group.root, "_rid")]))
    return at.join(near, [*keys, "_b"]).filter(FALLS).withColumn("_x", (F.col("_j") - F.col("_lo")).cast(WEIGHT)).drop("_j", "_lo", "_b", "_w", "_h")


def at_root(draws: DataFrame, sums: DataFrame, size: int) -> DataFrame:
    """Draws with the bucket that they fall on, by bins of numbers: a bucket is in all bins that it reaches into.

    Bins and buckets are bounded in number, so few rows of sums meet the draws, however many these are.
    """
    width = F.lit(str(size // BINS + 1)).cast(WEIGHT)
    place = lambda x: ((x - x % width) / width).cast("long")
    reach = sums.withColumn("_bin", F.explode(F.sequence(place(F.col("_lo")), place((F.col("_lo") + F.col("_w") - 1).cast(WEIGHT)))))
    return draws.withColumn("_bin", place(F.col("_j"))).join(reach, "_bin").filter(FALLS)


def into_band(draws: DataFrame, told: DataFrame, node: Node, mine: str, theirs: str) -> DataFrame:
    """For draws (draw, mine, _j) the child's key that _j falls on, as `theirs`, and what is left as _j."""
    sums = told.withColumnRenamed("_m", "_w")
    met = band_join(draws, mine, sums, theirs, node.edge.width).withColumn("_lo", running(["draw"], [theirs]))
    return met.filter(FALLS).select("draw", theirs, (F.col("_j") - F.col("_lo")).cast(WEIGHT).alias("_j"))


def descend(p: Prepared, node: Node, draws: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """(draw, <stream>_rid and columns...) for a node and all below it; draws: (draw, _j), with the parent's key as `_k...`."""
    keys: list[str] = []
    if node.edge:
        keys = key_columns(node, node.stream)
        mine = [f"_k{i}" for i in range(len(keys))]
        if node.edge.is_band:
            draws = into_band(draws, p.told[id(node)].raw, node, mine[0], keys[0])
        else:
            draws = draws.withColumnsRenamed(dict(zip(mine, keys)))
    found = look_up(p, node, draws, keys, columns)
    if node.children:
        found = keep(found, "found")
    own = [F.col(cell(m, "_rid")).alias(f"{m}_rid") for m in node.group.members]
    out = found.select("draw", *own, *[F.col(cell(m, c)).alias(f"{m}_{c}") for m in node.group.members for c in columns.get(m, ())])
    left = F.col("_x")
    for i, child in reversed(list(enumerate(node.children))):
        digit = (left % F.col(f"_m{i}")).cast(WEIGHT)
        mine = [F.col(c).alias(f"_k{n}") for n, c in enumerate(key_columns(child, child.parent_stream))]
        part = descend(p, child, found.select("draw", *mine, digit.alias("_j")), columns)
        out = out.join(part, "draw")
        left = F.floor((left - digit) / F.col(f"_m{i}")).cast(WEIGHT) if i else left
    return out


def resolve(p: Prepared, node: Node, draws: DataFrame, at: str, columns: dict[str, list[str]]) -> DataFrame:
    """draws with the names and columns of a node and all below it, for very many draws; at: the column of their numbers.

    draws have the parent's key columns. Each node's rows are put beside the draws in turn, so nothing is joined back by draw.
    """
    kind = number_type(p)
    keys = key_columns(node, node.stream) if node.edge else []
    if keys:
        draws = draws.withColumns({k: F.col(c) for k, c in zip(keys, key_columns(node, node.parent_stream))})
    sums, of_keys = p.sums, lambda rows: rows
    if keys:
        if node.children:  # rows of keys that no draw has may weigh more than the whole join
            draws = keep(draws, "found")
            asked = draws.select(*keys).distinct()
            of_keys = lambda rows: rows.join(asked, keys, "left_semi")
        sums = keep(of_keys(positions(p, node)).groupBy(*keys, "_b").agg(F.sum("_w").cast(WEIGHT).alias("_w"), F.count("*").alias("_n")), "sums")
    found = sums.agg(F.sum("_w").alias("w"), F.sum("_n").alias("n")).first()
    width = F.lit(str(int(found["w"] or 0) // min(ROW_BINS, found["n"] or 1) + 1)).cast(kind)
    place = lambda x: ((x - x % width) / width).cast("long") if kind == WEIGHT else F.call_function("div", x, width)
    before = sums.select(*keys, "_b", running(keys, ["_b"]).cast(kind).alias("_before"))
    rows = of_keys(positions(p, node, True, columns)).withColumn("_w", F.col("_w").cast(kind))
    inside = F.coalesce(F.sum("_w").over(W.partitionBy(*keys, "_b").orderBy("_h", cell(node.group.root, "_rid")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast(kind)
    rows = rows.withColumn("_inside", inside).join(before, [*keys, "_b"])
    rows = rows.withColumn("_lo", (F.col("_before") + F.col("_inside")).cast(kind)).withColumn("_hi", (F.col("_lo") + F.col("_w")).cast(kind))
    reach = rows.withColumn("_bin", F.explode(F.sequence(place(F.col("_lo")), place((F.col("_hi") - 1).cast(kind))))).drop("_b", "_h", "_before", "_inside", "_w")
    # The planner takes draws for a small table, as it can't see how many a generator makes, and would broadcast them.
    met = draws.withColumn("_bin", place(F.col(at))).hint("merge").join(reach, [*keys, "_bin"]).filter((F.col(at) >= F.col("_lo")) & (F.col(at) < F.col("_hi")))
    left, digits = (F.col(at) - F.col("_lo")).cast(kind), {}
    for i, child in reversed(list(enumerate(node.children))):
        own = F.col(f"_m{i}").cast(kind)
        digits[f"_at_{child.stream}"] = (left % own).cast(kind)
        left = ((left - left % own) / own).cast(kind) if kind == WEIGHT else F.call_function("div", left, own)
    own = [F.col(cell(m, "_rid")).alias(f"{m}_rid") for m in node.group.members] + [F.col(cell(m, c)).alias(f"{m}_{c}") for m in node.group.members for c in columns.get(m, ())]
    still = list(dict.fromkeys(c for child in node.children for c in key_columns(child, child.parent_stream)))
    rest = [c for c in draws.columns if c not in (at, *keys, *still)]
    out = met.select(*rest, *still, *own, *[c.alias(n) for n, c in digits.items()])
    for child in node.children:
        out = resolve(p, child, out, f"_at_{child.stream}", columns)
    return out


def number_type(p: Prepared) -> str:
    """A type that holds the numbers of all results, and what is added to them."""
    return "long" if p.size < 1 << 61 else WEIGHT


def unrank(p: Prepared, draws: DataFrame, columns: dict[str, list[str]] | None = None, expected: int = 0) -> DataFrame:
    """draws: (draw, _j) with 0 <= _j < the size of the join. Rows (draw, <stream>_rid for all streams).

    columns: of a stream, columns of its rows to add as <stream>_<column>. expected: how many draws there are, about, if many().
    """
    columns = columns or {}
    if not p.size:
        draws = draws.limit(0)
    if p.size and many(p, expected):
        out = resolve(p, p.top, draws.select("draw", F.col("_j").cast(number_type(p)).alias("_j")), "_j", columns)
    else:
        out = descend(p, p.top, draws.select("draw", F.col("_j").cast(WEIGHT).alias("_j")), columns)
    return out.select("draw", *[f"{s}_rid" for s in p.spec.streams], *[f"{s}_{c}" for s in p.spec.streams for c in columns.get(s, ())])


def many(p: Prepared, expected: int) -> bool:
    """Whether so many draws are better joined with rows than looked up: a band has draws look at its keys one by one either way."""
    return expected > MANY and not any(node.edge and node.edge.is_band for node in p.top.walk())
