"""From a query's parts to a tree of joins: checks, foreign-key folding, choice of the root.

Pure Python over names and types; no job runs here.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from tributary.plans.spec import Edge, QueryError, Spec, estimated_bytes

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass
class Group:
    """A stream with the streams that its foreign keys lead to, each reached from one that precedes it."""

    root: str
    folded: list[tuple[str, str, Edge]] = field(default_factory=list)  # (child, parent, edge)

    @property
    def members(self) -> list[str]:
        return [self.root, *(child for child, _, _ in self.folded)]


@dataclass
class Node:
    """A group in the join tree; edge and stream lead to the parent, which has parent_stream at its end."""

    group: Group
    edge: Edge | None = None
    stream: str | None = None
    parent_stream: str | None = None
    children: list[Node] = field(default_factory=list)

    def walk(self):
        yield self
        for child in self.children:
            yield from child.walk()


def check(spec: Spec) -> None:
    """Raise QueryError unless the query is a connected, acyclic join of fitting columns."""
    if not spec.streams:
        raise QueryError("a query needs a stream")
    for edge in spec.edges:
        for stream in (edge.left, edge.right):
            if stream not in spec.streams:
                raise QueryError(f"no stream {stream}")
        if edge.left == edge.right:
            raise QueryError(f"{edge.left} is joined with itself; add it under a second name")
        types = [[column_type(spec, s, c) for c in edge.cols(s)] for s in (edge.left, edge.right)]
        if len(types[0]) != len(types[1]) or types[0] != types[1]:
            raise QueryError(f"columns of {edge.left} and {edge.right} differ in type: {types[0]}, {types[1]}")
        if edge.is_band and (len(types[0]) != 1 or not isinstance(types[0][0], WHOLE)):
            raise QueryError("a band join is over one whole-number column")
        if edge.is_band and edge.width < 0:
            raise QueryError("a band is 0 or wider")
        if edge.foreign_key:
            if edge.is_band:
                raise QueryError("a foreign key is an equality")
            child = edge.other(edge.foreign_key)
            if set(spec.streams[child].primary_key) != set(edge.cols(child)):
                raise QueryError(f"{child} has no primary key {edge.cols(child)}")
    for f in spec.filters:
        kind = column_type(spec, f.stream, f.column)
        if f.kind == "band" and not isinstance(kind, WHOLE):
            raise QueryError("a band filter is over a whole-number column")
    if spec.window.kind != "none":
        if spec.window.size <= 0:
            raise QueryError("a window has a size above 0")
        for s in spec.streams.values():
            if s.ts is None or not isinstance(column_type(spec, s.name, s.ts), T.LongType):
                raise QueryError(f"a window needs a time column of type long in {s.name}")
    # Connected with one edge less than streams: a tree.
    seen, ahead = set(), [next(iter(spec.streams))]
    while ahead:
        at = ahead.pop()
        if at not in seen:
            seen.add(at)
            ahead += [e.other(at) for e in spec.edges if at in (e.left, e.right)]
    if len(seen) < len(spec.streams):
        raise QueryError(f"not joined with the rest: {sorted(set(spec.streams) - seen)}")
    if len(spec.edges) != len(spec.streams) - 1:
        raise QueryError("the join graph has a cycle, or two edges between a pair of streams")


def column_type(spec: Spec, stream: str, column: str) -> T.DataType:
    if stream not in spec.streams:
        raise QueryError(f"no stream {stream}")
    schema = spec.streams[stream].frame.schema
    if column not in schema.fieldNames():
        raise QueryError(f"{stream} has no column {column}")
    return schema[column].dataType


def fold(spec: Spec, use_keys: bool = True) -> dict[str, Group]:
    """The group of each stream. A stream that two foreign keys lead to goes with the first; the other stays an edge."""
    parent: dict[str, tuple[str, Edge]] = {}
    for edge in spec.edges if use_keys else ():
        if edge.foreign_key and (child := edge.other(edge.foreign_key)) not in parent:
            parent[child] = (edge.foreign_key, edge)
    groups = {s: Group(s) for s in spec.streams if s not in parent}
    of = dict(groups)
    waiting = [c for c in parent]
    while waiting:
        for child in list(waiting):
            above, edge = parent[child]
            if above in of:
                of[above].folded.append((child, above, edge))
                of[child] = of[above]
                waiting.remove(child)
    return of


def plan(spec: Spec, use_keys: bool = True, root: str | None = None) -> Node:
    """The join tree. Its root is the group of `root`, or else the one that folds most streams, of these the largest by the
    planner's estimate, of these the first: it alone is not aggregated before it is joined.
    """
    check(spec)
    of = fold(spec, use_keys)
    inner = {id(edge) for g in of.values() for _, _, edge in g.folded}
    edges = [e for e in spec.edges if id(e) not in inner]
    groups = list({id(g): g for g in of.values()}.values())
    start = of[root] if root else max(groups, key=lambda g: (len(g.members), estimated_bytes(spec.streams[g.root].frame)))

    def grow(group: Group, came: Edge | None) -> list[Node]:
        out = []
        for e in edges:
            if e is came:
                continue
            for mine in (e.left, e.right):
                if of[mine] is group:
                    theirs = e.other(mine)
                    node = Node(of[theirs], e, theirs, mine)
                    node.children = grow(node.group, e)
                    out.append(node)
        return out

    top = Node(start)
    top.children = grow(start, None)
    return top
