"""Command line: run a named query over a file of tagged lines, reporting at each marker.

    python -m tributary.cli -q tpcds_qy -a folded -s swor -r 10000 -i lines.txt -o report.txt
    python -m tributary.cli -q linear_road -w tumbling -t 60 -s swor -r 10000 -i lines.txt 3 300
    python -m tributary.cli convert linear_road reports.csv lines 0 1 3 F 60
"""

from __future__ import annotations

import argparse
import resource
import sys
import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary import named
from tributary.functions.text import report_line, sample_lines
from tributary.plans.spec import QueryError
from tributary.query import ALGORITHMS
from tributary.sources import converters, schemas
from tributary.sources.tagged import read_dat, read_lines, write_lines
from tributary.streaming.continuous import ContinuousQuery

#: Seconds between lines of the throughput file.
METER_EVERY = 0.5


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tributary", description="Join synopses over tagged lines.")
    p.add_argument("-q", "--query", required=True, choices=["linear_road", "tpcds_qx", "tpcds_qy", "tpcds_qz", "edgar", "f", "s", "t"])
    p.add_argument("-a", "--algorithm", default="folded", choices=ALGORITHMS)
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output", help="file for reports, besides the terminal")
    p.add_argument("-m", "--meter", help="file for throughput, a line every 0.5 s: seconds, reported rows since the last line, results since then")
    p.add_argument("-w", "--window", default="no_window", choices=["no_window", "tumbling", "sliding"])
    p.add_argument("-t", "--window-size", type=int, default=0)
    p.add_argument("-s", "--sampling", choices=["bernoulli", "swor", "swr"])
    p.add_argument("-r", "--rate", type=float, help="sample size, or the probability of bernoulli")
    p.add_argument("-n", "--no-dump", action="store_true", help="reports without the sample's rows")
    p.add_argument("-d", "--allow-deletion", action="store_true")
    p.add_argument("--seed", type=int, default=19950810)
    p.add_argument("parameters", nargs="*", type=int, help="linear_road: lanes, half bandwidth")
    return p


def run(args: argparse.Namespace, spark: SparkSession) -> list[dict]:
    lanes, width = (args.parameters + [3, 0])[:2] if args.query == "linear_road" else (3, 0)
    streams = named.streams_of(args.query, lanes)
    lines = read_lines(spark, args.input)
    empty = [spark.createDataFrame([], "line_no long, _dies long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in s.fields)) for _, s in streams]
    query = named.build(args.query, empty, args.algorithm, width=width)
    if args.window != "no_window":
        if args.window_size <= 0:
            raise QueryError("a window needs a size: -t")
        (query.set_tumbling_window if args.window == "tumbling" else query.set_sliding_window)(args.window_size)
    if args.sampling:
        if args.rate is None:
            raise QueryError("sampling needs a size or a rate: -r")
        make = {"bernoulli": query.set_bernoulli_sampling, "swor": query.set_sampling_without_replacement, "swr": query.set_sampling_with_replacement}
        make[args.sampling](args.rate, seed=args.seed)
    query.set_no_dumping(args.no_dump)
    work = ContinuousQuery(
        spark, query, {i: n for i, (n, _) in enumerate(streams)}, {i: s for i, (_, s) in enumerate(streams)}, null_as_zero=True, allow_deletes=args.allow_deletion, widths=schemas.WIDTHS,
    )
    out = open(args.output, "w") if args.output else None

    def tell(text: str) -> None:
        print(text)
        if out:
            print(text, file=out)

    def on_report(row: dict, sample: DataFrame | None) -> None:
        tell(report_line(*[row[k] for k in ("n_proc", "win_lo", "win_hi", "n_seen", "ssize", "ntup")]))
        if sample is not None and not args.no_dump:
            # All of it, a part of the table at a time.
            for r in sample_lines(sample, [f"{s}_rid" for s in query.spec.streams], "result_ts" if "result_ts" in sample.columns else None).toLocalIterator():
                tell(r["value"])

    work.on_report = on_report
    began = time.time()
    with Meter(args.meter, work):
        work.take(lines, 0)
    tell(f"execution duration: {time.time() - began:.3f} s")
    tell(f"peak memory: driver's JVM {jvm_peak(spark)} kB, driver's Python {resource.getrusage(resource.RUSAGE_SELF).ru_maxrss} kB")
    if out:
        out.close()
    return work.reported


class Meter:
    """While it is entered, writes a line every half a second, and a last one: seconds, rows and results of reports since the line before."""

    def __init__(self, path: str | None, work: ContinuousQuery):
        self.path, self.work, self.over = path, work, threading.Event()

    def __enter__(self) -> Meter:
        if self.path:
            self.file, self.began, self.told = open(self.path, "w"), time.time(), (0, 0)
            self.thread = threading.Thread(target=self.run, daemon=True)
            self.thread.start()
        return self

    def run(self) -> None:
        while not self.over.wait(METER_EVERY):
            self.line()

    def line(self) -> None:
        reported = list(self.work.reported)
        now = sum(r["ntup"] for r in reported), sum(r["n_proc"] for r in reported)
        self.file.write(f"{time.time() - self.began:.3f},{now[0] - self.told[0]},{now[1] - self.told[1]}\n")
        self.file.flush()
        self.told = now

    def __exit__(self, *_) -> None:
        if self.path:
            self.over.set()
            self.thread.join()
            self.line()
            self.file.close()


def jvm_peak(spark: SparkSession) -> int:
    """The most memory that the driver's JVM, which on one machine holds the data, has had: kB resident, or 0 where the system doesn't tell."""
    try:
        pid = spark._jvm.java.lang.ProcessHandle.current().pid()
        with open(f"/proc/{pid}/status") as status:
            return next((int(x.split()[1]) for x in status if x.startswith("VmHWM:")), 0)
    except OSError:
        return 0


def convert(argv: list[str], spark: SparkSession) -> None:
    """convert linear_road IN OUT DIR MIN_LANE MAX_LANE F|P PARAM; convert qx|qy|qz|qy_wd DAT_FOLDER OUT [SEED]."""
    kind, source, target, *rest = argv
    if kind == "linear_road":
        raw = read_lines(spark, source).filter(F.length("value") > 0)
        log = raw.select("line_no", F.lit("insert").alias("kind"), F.lit(0).alias("sid"), F.col("value").alias("payload"))
        from tributary.sources.tagged import parse_rows

        rows = parse_rows(log, 0, schemas.LINEAR_ROAD, null_as_zero=True).join(raw, "line_no")
        lines = converters.linear_road(rows, int(rest[0]), int(rest[1]), int(rest[2]), rest[3], int(rest[4]))
    else:
        seed = int(rest[0]) if rest else 1
        dat = lambda name, schema: read_dat(spark, f"{source}/{name}.dat", schema)
        pair = lambda df: converters.with_pair_key(df, "item_sk", "ticket_number", "item_sk_and_ticket_number")
        short = lambda s, n: type(s)(s.fields[:n])
        sales = pair(dat("store_sales", short(schemas.STORE_SALES, 12)))
        if kind == "qx":
            returns = pair(dat("store_returns", short(schemas.STORE_RETURNS, 11)))
            lines = converters.qx_lines(returns, dat("catalog_sales", schemas.CATALOG_SALES), dat("date_dim", schemas.DATE_DIM), sales, seed)
        else:
            customer, demographics = dat("customer", schemas.CUSTOMER), dat("household_demographics", schemas.HOUSEHOLD_DEMOGRAPHICS)
            if kind == "qz":
                lines = converters.qz_lines(sales, customer, dat("item", schemas.ITEM), demographics, seed)
            else:
                lines = converters.qy_lines(sales, customer, demographics, seed, deletes=kind == "qy_wd")
    write_lines(lines, target, ["line_no"])


def main(argv: list[str]) -> int:
    if argv[:1] == ["convert"]:
        convert(argv[1:], SparkSession.builder.getOrCreate())
        return 0
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 2 if not e.code else 1
    spark = SparkSession.builder.getOrCreate()
    try:
        run(args, spark)
    except (QueryError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
