"""The public interface: a join query, its size, its results by number, and samples of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators import deletes, enumerate as enumeration, maintain, sampling, tables, unrank, weights, windows
from tributary.plans.planner import Node, check, plan
from tributary.plans.spec import Edge, Filter, QueryError, SampleSpec, Spec, Stream, WindowSpec, names

ALGORITHMS = ("folded", "plain", "enumerate")


class JoinQuery:
    """An inner join of streams over a tree of equalities and bands, with filters, a window and a sampling method.

    algorithm: "folded" counts with foreign keys folded into the tables that hold them, "plain" takes them as
    ordinary equalities, "enumerate" makes every result. All three give the same counts.
    """

    def __init__(self, algorithm: str = "folded"):
        if algorithm not in ALGORITHMS:
            raise QueryError(f"no such algorithm: {algorithm}")
        self.algorithm = algorithm
        self.spec = Spec()
        self.report_handler: Callable[[DataFrame], None] | None = None
        self.dumping = True

    # What the query is.

    def add_stream(self, name: str, frame: DataFrame, rid=(), ts: str | None = None, primary_key=()) -> JoinQuery:
        """Add a table; the same DataFrame may come under several names. rid: columns that name a row."""
        if name in self.spec.streams:
            raise QueryError(f"there is a stream {name} already")
        self.spec.streams[name] = Stream(name, frame, names(rid), ts, names(primary_key))
        return self

    def add_equi_join(self, left: str, left_col, right: str, right_col, foreign_key: str | None = None) -> JoinQuery:
        """foreign_key: the stream whose column refers to the other's primary key, if any."""
        if foreign_key not in (None, left, right):
            raise QueryError(f"{foreign_key} is not part of this join")
        self.spec.edges.append(Edge(left, names(left_col), right, names(right_col), None, foreign_key))
        return self

    def add_band_join(self, left: str, left_col: str, right: str, right_col: str, width: int) -> JoinQuery:
        """|left - right| <= width, both ends included."""
        self.spec.edges.append(Edge(left, names(left_col), right, names(right_col), width))
        return self

    def add_equi_filter(self, stream: str, column: str, value) -> JoinQuery:
        self.spec.filters.append(Filter(stream, column, "equi", value))
        return self

    def add_neq_filter(self, stream: str, column: str, value) -> JoinQuery:
        self.spec.filters.append(Filter(stream, column, "neq", value))
        return self

    def add_band_filter(self, stream: str, column: str, operand, value) -> JoinQuery:
        """|column - operand| <= value."""
        self.spec.filters.append(Filter(stream, column, "band", value, operand))
        return self

    def set_unwindowed(self) -> JoinQuery:
        self.spec.window = WindowSpec()
        return self

    def set_tumbling_window(self, size: int) -> JoinQuery:
        self.spec.window = WindowSpec("tumbling", size)
        return self

    def set_sliding_window(self, size: int) -> JoinQuery:
        self.spec.window = WindowSpec("sliding", size)
        return self

    def set_bernoulli_sampling(self, rate: float, **options) -> JoinQuery:
        self.spec.sampling = SampleSpec("bernoulli", rate, **options)
        return self

    def set_sampling_without_replacement(self, size: int, **options) -> JoinQuery:
        self.spec.sampling = SampleSpec("swor", size, **options)
        return self

    def set_sampling_with_replacement(self, size: int, **options) -> JoinQuery:
        self.spec.sampling = SampleSpec("swr", size, **options)
        return self

    def set_key_semantics(self, order: str | None = None, first_wins: bool = False) -> JoinQuery:
        """Depart from relational foreign keys. order: a whole-number column of all streams; a row then only finds
        keys that arrived before it, and of rows with one key only the first counts, as first_wins alone also has it.
        """
        self.spec.key_order, self.spec.first_key_wins = order, first_wins or order is not None
        return self

    def key_problems(self, most: int = 10) -> DataFrame:
        """(problem, stream, key): up to `most` keys each, by edge, that occur twice or that references miss."""
        return weights.key_problems(self.spec, most)

    def set_report_event_handler(self, handler: Callable[[DataFrame], None]) -> JoinQuery:
        """Called with each report's one-row table instead of printing it."""
        self.report_handler = handler
        return self

    def set_no_dumping(self, off: bool = True) -> JoinQuery:
        """Reports without the sample's rows."""
        self.dumping = not off
        return self

    # What it gives.

    def plan(self) -> Node:
        return plan(self.spec, self.algorithm == "folded")

    def live(self, at: int | None = None) -> JoinQuery:
        """The query over what the window holds at a time (default: the latest of the data)."""
        if self.spec.window.kind == "none":
            return self
        check(self.spec)
        at = windows.latest(self.spec) if at is None else at
        return self._with(windows.live(self.spec, 0 if at is None else at))

    def after_deletes(self, orders: dict[str, str], counts: dict[str, int]) -> JoinQuery:
        return self._with(deletes.after_deletes(self.spec, orders, counts))

    def _with(self, spec: Spec) -> JoinQuery:
        out = JoinQuery(self.algorithm)
        out.spec, out.report_handler, out.dumping = spec, self.report_handler, self.dumping
        return out

    def count_frame(self, trust_keys: bool = False) -> DataFrame:
        """n_seen as bigint, in tumbling windows with its window; an overflow of bigint is an error.

        trust_keys: leave out folded tables that give no column, as every reference has its target.
        """
        if self.spec.window.kind == "sliding":
            raise QueryError("a sliding window has a size at a time: live(at).count_frame()")
        if self.algorithm == "enumerate":
            rows = enumeration.results(self.spec)
            if self.spec.window.kind == "tumbling":
                first = tables.floor_div(F.col("result_ts"), self.spec.window.size)
                return rows.groupBy(first.alias("window")).agg(F.count("*").alias("n_seen"))
            return rows.agg(F.count("*").alias("n_seen"))
        out = weights.total(self.spec, self.plan(), trust_keys)
        return out.withColumn("n_seen", F.col("n_seen").cast("long"))

    def num_seen(self) -> int:
        """The number of live results."""
        q = self.live()
        if q.algorithm == "enumerate":
            return int(q.count_frame().first()["n_seen"])
        return int(weights.total(q.spec, q.plan()).first()["n_seen"])

    def row_weights(self) -> DataFrame:
        """(rid, weight) of the root table's rows that have results."""
        top = self.plan()
        rows = weights.row_weights(self.spec, top)
        return rows.select(F.col(weights.cell(top.group.root, "_rid")).alias("rid"), F.col("_w").cast("long").alias("weight"))

    def results(self) -> DataFrame:
        """All results; see operators.enumerate."""
        return enumeration.results(self.spec)

    def by_numbers(self, numbers: list[int], columns: dict[str, list[str]] | None = None) -> DataFrame:
        """Results by number: (draw, <stream>_rid..., <stream>_<column>...), draw being the place in the list."""
        q = self.live()
        spark = next(iter(self.spec.streams.values())).frame.sparkSession
        return unrank.unrank(unrank.prepare(q.spec, q.plan()), sampling.numbers_frame(spark, numbers), columns)

    def samples(self, columns: dict[str, list[str]] | None = None, with_ts: bool = False) -> DataFrame:
        """The sample of the live results: (draw, <stream>_rid...).

        columns: of a stream, columns of its rows to add as <stream>_<column>, at no further pass over the tables.
        with_ts: result_ts too, the least time of a result's rows, which all streams must have.
        """
        how = self.spec.sampling
        if how is None:
            raise QueryError("no sampling method is set")
        streams = self.spec.streams
        own = {s: list((columns or {}).get(s, ())) for s in streams}
        if with_ts:
            if not all(s.ts for s in streams.values()):
                raise QueryError("a result has a time if all streams have")
            wide = {s: list(dict.fromkeys([*own[s], streams[s].ts])) for s in streams}
            times = [F.col(f"{s}_{streams[s].ts}") for s in streams]
            least = (F.least(*times) if len(times) > 1 else times[0]).alias("result_ts")
            rids = [f"{s}_rid" for s in streams]
            return self.samples(wide).select("draw", *rids, least, *[f"{s}_{c}" for s in streams for c in own[s]])
        q = self.live()
        rids = [f"{s}_rid" for s in q.spec.streams]
        spark = next(iter(q.spec.streams.values())).frame.sparkSession
        if q.algorithm == "enumerate":
            made = enumeration.results(q.spec).select(*rids)
            if how.kind != "swor":  # the least hashes take one pass over results, so these need not be written
                made = tables.keep(made, "results")
            if how.kind == "bernoulli":
                sample = sampling.bernoulli_of(made, rids, how.amount, how.seed)
            else:
                sample = sampling.bottom_k(made, rids, int(how.amount), how.seed)
            if how.kind == "swr":
                sample = sampling.with_replacement(tables.keep(sample, "sample"), rids, made.count(), int(how.amount), how.seed)
            else:
                sample = sample.select(sampling.result_hash(sample, rids, how.seed).alias("_h"), *rids).select(F.conv(F.substring("_h", 1, 15), 16, 10).cast("long").alias("draw"), *rids)
            return q.resolve(sample, {s: c for s, c in own.items() if c}) if columns else sample
        ready = unrank.prepare(q.spec, q.plan())
        if how.kind == "bernoulli":
            expected = int(ready.size * how.amount)
            numbers = sampling.bernoulli_numbers(spark, how, ready.size) if ready.size else sampling.numbers_frame(spark, [])
            if ready.size and not unrank.many(ready, expected):  # several steps read few; many are read once, and not written
                numbers = tables.keep(numbers, "numbers")
            return unrank.unrank(ready, numbers, own, expected)
        return unrank.unrank(ready, sampling.numbers_frame(spark, sampling.draw_numbers(how, ready.size)), own)

    def added(self, new: dict[str, DataFrame]) -> int:
        """How many results rows to come would add, by stream; old results are not counted again."""
        q = self.live()
        return sum(n for _, n in maintain.added(q.spec, new, q.algorithm == "folded"))

    def grown(self, new: dict[str, DataFrame]) -> JoinQuery:
        """The query over its rows and further ones."""
        return self._with(maintain.grown(self.spec, new))

    def absorbed(self, sample: DataFrame, new: dict[str, DataFrame]) -> DataFrame:
        """A sample of this query, made one of grown(new); only added results are drawn."""
        return maintain.absorbed(self.spec, sample, new, self.algorithm == "folded")

    def repaired(self, sample: DataFrame, nth: int = 0) -> DataFrame:
        """A sample of an earlier state of the tables, made one of the present state; nth: the number of this repair."""
        return deletes.repaired(self.spec, sample, self.spec.sampling, self.algorithm == "folded", nth)

    def resolve(self, sample: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
        """The sample with columns of its members' rows, as <stream>_<column>; of rows with equal names, one.

        Reads the tables again: where the columns are known before, samples(columns) doesn't.
        """
        out = sample
        for name, own in columns.items():
            s = self.spec.streams[name]
            rows = s.frame.select(tables.rid(s).alias(f"{name}_rid"), *[F.col(c).alias(f"{name}_{c}") for c in own])
            named = rows.join(sample.select(f"{name}_rid").distinct(), f"{name}_rid", "left_semi").dropDuplicates([f"{name}_rid"])
            out = out.join(named, f"{name}_rid")
        return out

    def estimate(self, sample: DataFrame, value) -> DataFrame:
        """From a resolved sample without or with replacement: the join's estimated sum and average of a column."""
        size = self.num_seen()
        return sample.agg((F.avg(value) * F.lit(size)).alias("estimated_sum"), F.avg(value).alias("estimated_avg"), F.lit(size).alias("n_seen"))
