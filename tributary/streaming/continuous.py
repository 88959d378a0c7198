"""A join query over a stream of tagged lines: state tables, reports at markers, samples, a meter."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.text import report_line
from tributary.operators import reports
from tributary.operators.tables import shared_dir
from tributary.plans.spec import Spec
from tributary.query import JoinQuery
from tributary.sources.tagged import in_order, parse_log, parse_rows

LOG = "line_no long, kind string, sid int, n long, payload string"


class ContinuousQuery:
    """Takes lines by micro-batches and reports at each marker.

    The log is the state: a folder in the shared directory to which each batch adds its lines once, under its batch
    id, so a batch that is repeated after a failure replaces itself. For the markers of a batch the log is read once:
    it derives which rows are stored, counts live and produced results by weights, and the sample of each marker's state
    is drawn. Nothing that grows is kept in the driver. compact() drops rows that no later report can see, and with them
    the work of later batches.

    Lines need a line_no that grows over the stream; files get theirs from place and batch.
    """

    def __init__(self, spark: SparkSession, query: JoinQuery, sids: dict[int, str], schemas: dict[int, T.StructType], null_as_zero: bool = False, allow_deletes: bool = True, widths: dict[str, int] | None = None):
        self.spark, self.query, self.sids, self.schemas = spark, query, sids, schemas
        self.null_as_zero, self.allow_deletes, self.widths = null_as_zero, allow_deletes, widths
        self.path = f"{shared_dir(spark).rstrip('/')}/continuous-{uuid.uuid4().hex}"
        self.reported: list[dict] = []
        #: For each batch: seconds since the start, its inserted rows, results produced so far.
        self.meter: list[tuple[float, int, int]] = []
        self.made = 0
        self._last = -1
        self._ended: int | None = None
        self._first: dict[int, int] = {}
        self._began = time.time()
        self.on_report: Callable[[dict, DataFrame | None], None] = lambda row, sample: print(report_line(*[row[k] for k in ("n_proc", "win_lo", "win_hi", "n_seen", "ssize", "ntup")]))

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(f"{self.path}/*")

    def take(self, lines: DataFrame, batch_id: int) -> None:
        """One micro-batch of (line_no, value). After an empty line, the end of input, further batches are not read."""
        if self._ended is not None and batch_id > self._ended:
            return
        ends = lines.filter(F.length("value") == 0).limit(1).count() > 0
        batch = parse_log(lines)
        batch.write.mode("overwrite").parquet(f"{self.path}/{batch_id:012d}")
        if ends:
            self._ended = batch_id
        stored = self.spark.read.schema(LOG).parquet(f"{self.path}/{batch_id:012d}")
        if not self.allow_deletes and stored.filter("kind = 'delete'").limit(1).count():
            raise ValueError("a delete line, but deletes are not allowed")
        marks = [r["line_no"] for r in stored.filter("kind = 'report'").select("line_no").orderBy("line_no").collect()]
        self.report([at for at in marks if at > self._last])
        self.meter.append((time.time() - self._began, stored.filter("kind = 'insert'").count(), self.made))

    def tables(self, log: DataFrame) -> dict[str, DataFrame]:
        return {name: parse_rows(log, sid, self.schemas[sid], null_as_zero=self.null_as_zero, widths=self.widths) for sid, name in self.sids.items()}

    def report(self, marks: list[int]) -> None:
        """Reports at these markers; one pass over the log counts for all of them."""
        if not marks:
            return
        spec, log = self.query.spec, self.log().filter(F.col("line_no") < marks[-1])
        rows = self.tables(log)
        deletes = log.filter("kind = 'delete'").select("line_no", "sid", "n")
        own = {n: reports.filtered(rows[n], [f for f in spec.filters if f.stream == n]) for n in spec.streams}
        lived = reports.with_lifetimes(spec, own, deletes, self.sids)
        since = [self._last] if self._last >= 0 else []
        found = reports.history(spec, lived, deletes, [*since, *marks], self.query.algorithm != "plain")
        before = found[0] if since else {"made": 0, "tuples": 0}
        for h in found[len(since) :]:
            low, high = reports.bounds(spec.window, h["top"])
            sample, size, how = None, h["n_seen"], spec.sampling
            if how and self.query.dumping:
                sample = self.sample_at(spec, lived, h, len(self.reported))
            ssize = 0 if not how else sample.count() if how.kind == "bernoulli" and sample is not None else 0 if not size else int(how.amount) if how.kind == "swr" else min(int(how.amount or 0), size)
            row = {"n_proc": h["made"] - before["made"], "win_lo": low, "win_hi": high, "n_seen": size, "ssize": ssize, "ntup": h["tuples"] - before["tuples"]}
            before, self._last = h, h["line_no"]
            self.made += row["n_proc"]
            self.reported.append(row)
            (self.query.report_handler or (lambda r: self.on_report(r, sample)))(row)  # noqa: B023

    def sample_at(self, spec: Spec, lived: dict[str, DataFrame], h: dict, nth: int) -> DataFrame:
        """The sample of the results that are live at a marker; with the results' times, if all streams have times."""
        now = reports.alive(spec, lived, h["line_no"])
        view = JoinQuery(self.query.algorithm)
        view.spec = replace(now, streams={n: replace(s, rid=s.rid or ("line_no",)) for n, s in now.streams.items()})
        live = view.live(h["top"]) if spec.window.kind != "none" else view
        live.spec.sampling = replace(spec.sampling, seed=spec.sampling.seed + nth)
        return live.samples(with_ts=spec.window.kind != "none")

    def start(self, lines: DataFrame, **options):
        """Run over a streaming DataFrame of lines (value, and line_no unless their source gives the order).

        Files are taken in the order of their names within a micro-batch, other sources' rows in that of partitions. Lines are
        numbered without gaps, from the last number of the batches before.
        """
        checkpoint = f"{self.path}-checkpoint"
        if "line_no" not in lines.columns:
            try:
                lines = lines.select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
            except AnalysisException:  # not a source of files
                lines = lines.select("value", F.lit("").alias("f"), F.lit(None).cast("long").alias("b"))

        def each(batch: DataFrame, batch_id: int) -> None:
            if "line_no" not in batch.columns:
                batch = in_order(batch, self.next_line(batch_id))
            self.take(batch.select("line_no", "value"), batch_id)

        writer = lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        return (writer.trigger(**options) if options else writer.trigger(availableNow=True)).start()

    def next_line(self, batch_id: int) -> int:
        """The number of a batch's first line: after all lines of the batches before, also if the batch is repeated."""
        if batch_id not in self._first:
            self._first[batch_id] = max([self._last, *[r[0] for r in self.log().agg(F.max("line_no")).collect() if r[0] is not None]]) + 1 if self._first or self._last >= 0 else 0
        return self._first[batch_id]

    def compact(self, before: int) -> None:
        """Drop from the log rows that are gone for good: deleted, or left behind by the window, by a line."""
        log = self.log().filter(F.col("line_no") < before)
        spec, rows = self.query.spec, self.tables(log)
        deletes = log.filter("kind = 'delete'")
        # As in report(): rows that filters drop are not stored, so deletes don't count them.
        rows = {n: reports.filtered(rows[n], [f for f in spec.filters if f.stream == n]) for n in spec.streams}
        kept = []
        for sid, name in self.sids.items():
            lived = reports.lifetimes(rows[name], deletes.filter(F.col("sid") == sid).select("line_no", "n")).filter("_dies IS NULL")
            s = spec.streams[name]
            if s.ts and spec.window.kind != "none":
                top = max((r for r in (df.agg(F.max(spec.streams[n].ts)).first()[0] for n, df in rows.items()) if r is not None), default=0)
                lived = lived.filter(F.col(s.ts) >= reports.bounds(spec.window, top)[0])
            kept.append(lived.select("line_no"))
        alive = kept[0]
        for k in kept[1:]:
            alive = alive.unionByName(k)
        small = log.join(alive, "line_no", "left_semi").select("line_no", "kind", "sid", "n", "payload")
        later = self.log().filter(F.col("line_no") >= before)
        path = f"{shared_dir(self.spark).rstrip('/')}/continuous-{uuid.uuid4().hex}"
        small.unionByName(later).write.parquet(f"{path}/{0:012d}")
        self.path = path
