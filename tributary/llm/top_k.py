"""Exact top-k inner products by pivot elimination.

A table of pivots is made once and stored beside the vectors: the distance of every vector to each of many pivots, the origin
among them. A query's distance to a vector is at least the largest difference of their distances to a pivot, and a lower
bound of the distance is an upper bound of the inner product, as lengths are known. Candidates of a table are evaluated in
the order of their bounds, until the next bound is below the k-th best score so far, which is exact: none that is left can
enter. Scores are integer products, and bounds give way by more than their rounding error, ties included.

Queries are rows of a stored table too, with their distances to the pivots and a first k-th best score, from a
bounded number of vectors that is sent to all tasks; so a task starts with a score to beat. Stage by stage, queries of
at most about `stage_bytes` are broadcast and all vectors are read once, by one scan; what a stage finds is
written before the next. A task keeps the best k of each query and passes on those that reach the first score.

Defined results: a vector that is null, or has a null or non-finite component (scaled: beyond a double), takes no part, nor
does a null id. Vectors of another length than the query's are no candidates of it. Repeated rows are candidates each; a
repeated query is answered once, and queries that share an id but differ are answered each. Products are exact
for components of any size; a score beyond a long is shown as the nearest long, its rank is by the exact product.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.llm.common import discard, settle

PIVOTS = 32
#: Vectors of a table, queries of one, and vectors that queries get their first k-th best score from.
TABLE_ROWS, QUERY_ROWS, SEEDS = 4096, 512, 2048
#: Bytes of queries that are broadcast at once, about.
STAGE_BYTES = 16 << 20

TABLE = "dim int, n int, most double, ids binary, kind string, vectors binary, squares binary, distances binary"


class Best:
    """The best k of each query so far: score descending, then id ascending. floors: scores that a candidate must reach."""

    def __init__(self, floors: list[int | None], k: int):
        self.k, self.floors = k, list(floors)
        self.rows: list[list[tuple[int, int]]] = [[] for _ in floors]  # (-score, id)

    def worst(self, q: int) -> int | None:
        own = -self.rows[q][-1][0] if len(self.rows[q]) == self.k else None
        floor = self.floors[q]
        return own if floor is None else floor if own is None else max(own, floor)

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if scores.dtype != object and len(scores) > self.k:
            at = np.lexsort((ids, -scores))[: self.k]
            scores, ids = scores[at], ids[at]
        self.rows[q] = sorted([*self.rows[q], *zip((-scores).tolist(), ids.tolist())])[: self.k]


def squares_of(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.einsum("ij,ij->i", vectors, vectors)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of a to rows of b, and to the origin; components beyond what squares can hold give inf."""
    with np.errstate(over="ignore", invalid="ignore"):
        squares = squares_of(a)
        apart = squares[:, None] + squares_of(b)[None, :] - 2 * (a @ b.T)
        out = np.sqrt(np.maximum(np.hstack([squares[:, None], apart]), 0)).astype(np.float32)
    out[~np.isfinite(out)] = np.inf
    return out


def products(vectors: np.ndarray, query: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of whole-valued doubles; most: above each product and each of its sums."""
    if most < 2**52:
        return (vectors @ query).astype(np.int64)
    if most < 2**62:
        return vectors.astype(np.int64) @ query.astype(np.int64)
    own = [int(x) for x in query.tolist()]
    return np.array([sum(int(x) * y for x, y in zip(row, own)) for row in vectors.tolist()], object)


def search_table(best: Best, query_ids: np.ndarray, queries: np.ndarray, to_pivots: np.ndarray, ids: np.ndarray, vectors: np.ndarray, squares: np.ndarray, table: np.ndarray, reach: float) -> int:
    """Offer the candidates of one table to all queries; returns how many products it took.

    to_pivots, table: distances to the pivots; reach: the greatest length of a pivot.
    """
    columns = np.ascontiguousarray(table.T)
    lengths, query_squares = np.sqrt(squares), squares_of(queries)
    tops, query_tops = np.abs(vectors).max(initial=0), np.abs(queries).max(axis=1, initial=0)
    taken = 0
    for q in range(len(queries)):
        with np.errstate(over="ignore", invalid="ignore"):
            bound = np.zeros(len(ids), np.float32)
            for p in range(len(columns)):
                np.fmax(bound, np.abs(columns[p] - to_pivots[q, p]), out=bound)  # inf - inf is no bound
            low = bound.astype(np.float64)
            low[~np.isfinite(low)] = 0
            low = np.maximum(low - 1e-5 * (lengths + np.sqrt(query_squares[q]) + reach) - 1e-3, 0)
            highest = (squares + query_squares[q] - low * low) / 2 + 1e-6 * (squares + query_squares[q]) + 0.5
            highest[~np.isfinite(highest)] = np.inf
        order, at, size = None, 0, 64
        while at < len(ids):
            worst = best.worst(q)
            if order is None:
                live = np.flatnonzero(highest >= worst) if worst is not None else np.arange(len(ids))
                order = live[np.argsort(-highest[live])]
            if at >= len(order) or (worst is not None and highest[order[at]] < worst):
                break
            part = order[at : at + size]
            taken += len(part)
            scores = products(vectors[part], queries[q], tops * query_tops[q] * vectors.shape[1])
            other = ids[part] != query_ids[q]
            if worst is not None:
                other &= (scores >= worst).astype(bool)
            if other.any():
                best.offer(q, scores[other], ids[part][other])
            at, size = at + size, size * 2
    return taken


def first_floors(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[int | None]:
    """The k-th best score of each query among some vectors, or None if these are fewer."""
    if len(ids) <= k:
        return [None] * len(queries)
    tops, query_tops = np.abs(vectors).max(initial=0), np.abs(queries).max(axis=1, initial=0)
    out = []
    for q, own in enumerate(queries):
        scores = products(vectors, own, tops * query_tops[q] * vectors.shape[1])[ids != query_ids[q]]
        out.append(int(np.sort(scores)[-k]) if len(scores) >= k else None)
    return out


def whole(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): rows that take part, components scaled and floored, as doubles that hold whole numbers."""
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x * F.lit(float(scale)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(sound)  # floored where they are packed: floor() of doubles gives longs here, which large ones exceed


def packed(rows: DataFrame, pivots: dict[int, np.ndarray], size: int) -> DataFrame:
    """Tables of up to `size` vectors of one length, with their distances to the pivots."""
    import pyarrow as pa

    schema = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("most", pa.float64()), ("ids", pa.binary()), ("kind", pa.string()), *[(c, pa.binary()) for c in ("vectors", "squares", "distances")]])

    def tables(it):
        held: dict[int, list] = {}
        for b in it:
            ids, lists = b.column(0).to_numpy(), b.column(1)
            sizes = lists.value_lengths().to_numpy()
            flat = np.floor(lists.flatten().to_numpy())
            ends = np.cumsum(sizes)
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                values = flat.reshape(-1, d) if len(at) == len(sizes) else np.stack([flat[ends[i] - d : ends[i]] for i in at])
                own = held.setdefault(d, [])
                for k in range(0, len(at), size):
                    own.append((ids[at[k : k + size]], values[k : k + size]))
                    if sum(len(x) for x, _ in own) >= size:
                        yield d, *map(np.concatenate, zip(*held.pop(d)))
                        own = held.setdefault(d, [])
        for d, own in held.items():
            if own:
                yield d, *map(np.concatenate, zip(*own))

    def run(it):
        for d, ids, values in tables(it):
            most = float(np.abs(values).max(initial=0))
            kind = "<i4" if most < 2**31 else "<f8"
            to = distances(values, pivots.get(d, np.zeros((0, d))))
            row = (d, len(ids), most, ids.tobytes(), kind, values.astype(kind).tobytes(), squares_of(values).tobytes(), to.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types)], schema=schema)

    return rows.mapInArrow(run, TABLE)


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, vectors, squares and distances of a table's row."""
    n = row["n"]
    return (
        np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], row["kind"]).reshape(n, row["dim"]).astype(np.float64),
        np.frombuffer(row["squares"], np.float64), np.frombuffer(row["distances"], np.float32).reshape(n, -1),
    )


def stages(queries: DataFrame, most: int):
    """Lists of the rows of a small-rowed table, of about `most` bytes each; the driver holds one at a time."""
    held, size = [], 0
    for r in queries.toLocalIterator():
        held.append(r.asDict())
        size += len(r["vectors"]) + len(r["distances"])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, pivots: int = PIVOTS, seeds: int = SEEDS,
    block: int = QUERY_ROWS, stage_bytes: int = STAGE_BYTES,
) -> DataFrame:
    """Rows (query_id, rank, id, score): each query's k largest products with vectors of other ids."""
    import pyarrow as pa

    spark = vectors.sparkSession
    rows, asked = whole(vectors, id_col, vector_col, scale), whole(queries, id_col, vector_col, scale).distinct()
    by_length: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id", "v").limit(pivots + seeds).collect():
        by_length.setdefault(len(r["v"]), []).append((r["id"], np.floor(r["v"])))
    chosen = {d: np.array([v for _, v in own[:pivots]]) for d, own in by_length.items()}
    reach = {d: float(np.sqrt(squares_of(p).max(initial=0))) for d, p in chosen.items()}
    first = spark.sparkContext.broadcast({d: (np.array([i for i, _ in own]), np.array([v for _, v in own])) for d, own in by_length.items()})
    table = settle(packed(rows, chosen, TABLE_ROWS), "pivot_table", "zstd")

    def with_floors(it):
        for b in it:
            for r in b.to_pylist():
                ids, values, _, _ = unpacked(r)
                seed_ids, seed_vectors = first.value.get(r["dim"], (np.zeros(0, np.int64), np.zeros((0, r["dim"]))))
                floors = [None if x is None else str(x) for x in first_floors(ids, values, seed_ids, seed_vectors, k)]
                yield pa.RecordBatch.from_arrays([*[pa.array([r[f.name]], f.type) for f in b.schema], pa.array([floors], pa.list_(pa.string()))], names=[*b.schema.names, "floors"])

    asked = settle(packed(asked, chosen, block).mapInArrow(with_floors, f"{TABLE}, floors array<string>"), "queries", "zstd")

    def search(values: list[dict]) -> DataFrame:
        wanted: dict[int, list] = {}
        for r in values:
            wanted.setdefault(r["dim"], []).append((r["floors"], *unpacked(r)))
        sent = spark.sparkContext.broadcast({d: ([None if f is None else int(f) for x in own for f in x[0]], *[np.concatenate([x[c] for x in own]) for c in (1, 2, 4)]) for d, own in wanted.items()})

        def run(it):
            best = {d: Best(x[0], k) for d, x in sent.value.items()}
            for b in it:
                for i in range(b.num_rows):
                    r = {name: b.column(name)[i].as_py() for name in b.schema.names}
                    if r["dim"] in best:
                        _, query_ids, query_values, to_pivots = sent.value[r["dim"]]
                        search_table(best[r["dim"]], query_ids, query_values, to_pivots, *unpacked(r), reach.get(r["dim"], 0.0))
            for d, (_, query_ids, _, _) in sent.value.items():
                found = [(q, -s, i) for q, own in enumerate(best[d].rows) for s, i in own]
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    columns = [pa.array([d] * len(part), pa.int32()), pa.array([q for q, _, _ in part], pa.int32()), pa.array([int(query_ids[q]) for q, _, _ in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([i for _, _, i in part], pa.int64()), pa.array([str(s) for _, s, _ in part])], names=["dim", "q", "query_id", "id", "exact"])

        # Scores are ranked as they are: by sign, then by number of digits, then by digits.
        found = table.mapInArrow(run, "dim int, q int, query_id long, id long, exact string")
        below, digits = F.col("exact").startswith("-"), F.ltrim("exact", F.lit("-"))
        order = [below, F.when(below, F.length("exact")).otherwise(-F.length("exact")), F.when(below, digits), F.when(~below, digits).desc(), "id"]
        nth = F.row_number().over(W.partitionBy("dim", "q").orderBy(*order))
        return found.withColumn("rank", nth).filter(F.col("rank") <= k)

    # All but the last stage are written, so that no more than one stage's queries are held anywhere.
    found, ahead = None, None
    for values in stages(asked, stage_bytes):
        if ahead is not None:
            part = settle(search(ahead), "stage_of_queries", "zstd")
            found = part if found is None else found.unionByName(part)
        ahead = values
    first.destroy()
    discard(asked)
    if ahead is None:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score long")
    found = search(ahead) if found is None else found.unionByName(search(ahead))
    nearest = F.coalesce(F.expr("try_cast(exact AS bigint)"), F.when(F.col("exact").startswith("-"), F.lit(-(1 << 63))).otherwise(F.lit((1 << 63) - 1)))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), nearest.cast("long").alias("score"))
