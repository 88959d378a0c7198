"""Tagged lines, converters, the continuous query and the command line."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tributary import cli, named
from tributary.functions.text import report_line
from tributary.query import JoinQuery
from tributary.sources import converters, schemas
from tributary.sources.schemas import schema
from tributary.sources.tagged import parse_log, parse_rows, read_dat, read_lines, write_lines
from tributary.streaming.continuous import ContinuousQuery

MINI = ["0|1", "1|1", "1|1", "0|1", "0|2", "-", "d 0 1", "-", "", "0|1"]


def numbered(spark, lines):
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no long, value string")


def test_log(spark):
    log = parse_log(numbered(spark, MINI)).collect()
    assert [(r["kind"], r["sid"], r["n"], r["payload"]) for r in sorted(log, key=lambda r: r["line_no"])] == [
        ("insert", 0, None, "1"), ("insert", 1, None, "1"), ("insert", 1, None, "1"), ("insert", 0, None, "1"), ("insert", 0, None, "2"),
        ("report", None, None, None), ("delete", 0, 1, None), ("report", None, None, None),
    ]


def test_records(spark):
    three = schema("a:int b t:string u:string d:date x:double v:string")
    lines = ["0|12|9000000001|two words|uvw|1999-12-31|2.5|xyzzy", '0|1||"q|r"|z||| ', "0|7|8|s"]
    log = parse_log(numbered(spark, lines))
    rows = sorted(parse_rows(log, 0, three, sep="|", null_as_zero=True, widths={"v": 2}).collect(), key=lambda r: r["line_no"])
    assert tuple(rows[0])[1:] == (12, 9000000001, "two words", "uvw", datetime.date(1999, 12, 31), 2.5, "xy")
    assert (rows[1]["a"], rows[1]["b"], rows[1]["t"], rows[1]["d"], rows[1]["x"]) == (1, 0, "q|r", None, 0.0)
    assert (rows[2]["a"], rows[2]["b"], rows[2]["t"], rows[2]["x"], rows[2]["u"]) == (7, 8, "s", 0.0, None)
    plain = sorted(parse_rows(log, 0, three, sep="|").collect(), key=lambda r: r["line_no"])
    assert plain[1]["b"] is None


def test_widths_are_in_bytes(spark):
    log = parse_log(numbered(spark, ["0|äöü", "0|aäb", "0|日本語", "0|abc", "0|", "0|a😀"]))
    got = [r["t"] for r in sorted(parse_rows(log, 0, schema("t:string"), null_as_zero=True, widths={"t": 3}).collect(), key=lambda r: r["line_no"])]
    assert got == ["ä", "aä", "日", "abc", None, "a"]


def test_lines_keep_their_order(spark, tmp_path):
    lines = [f"0|{i}" for i in range(5000)]
    write_lines(numbered(spark, lines).repartition(7), str(tmp_path / "out"), ["line_no"])
    got = [r["value"] for r in read_lines(spark, str(tmp_path / "out")).orderBy("line_no").collect()]
    assert got == lines


def mini_query(spark):
    empty = spark.createDataFrame([], "line_no long, k long")
    q = JoinQuery()
    for n in ("a", "b"):
        q.add_stream(n, empty, "line_no")
    return q.add_equi_join("a", "k", "b", "k").set_sampling_without_replacement(3)


def test_continuous_reports(spark):
    work = ContinuousQuery(spark, mini_query(spark), {0: "a", 1: "b"}, {0: schema("k"), 1: schema("k")})
    samples = []
    work.on_report = lambda row, sample: samples.append(sample.collect())
    work.take(numbered(spark, MINI), 0)
    assert [(r["n_proc"], r["n_seen"], r["ssize"], r["ntup"]) for r in work.reported] == [(4, 4, 3, 5), (0, 2, 2, 1)]
    assert [len(s) for s in samples] == [3, 2]


def test_continuous_batches_and_compaction(spark):
    """The same log in three batches, a batch taken twice, and old rows dropped between."""
    work = ContinuousQuery(spark, mini_query(spark), {0: "a", 1: "b"}, {0: schema("k"), 1: schema("k")})
    work.on_report = lambda row, sample: None
    lines = numbered(spark, MINI[:8])
    work.take(lines.filter("line_no < 3"), 0)
    work.take(lines.filter("line_no >= 3 AND line_no < 6"), 1)
    work.take(lines.filter("line_no >= 3 AND line_no < 6"), 1)
    work.take(lines.filter("line_no >= 6"), 2)
    assert [(r["n_proc"], r["n_seen"]) for r in work.reported] == [(4, 4), (0, 2)]
    work.compact(8)
    assert sorted(r["line_no"] for r in work.log().collect()) == [1, 2, 3, 4]
    work.take(spark.createDataFrame([(8, "1|1"), (9, "-")], "line_no long, value string"), 3)
    assert work.reported[-1]["n_seen"] == 3 and work.reported[-1]["n_proc"] == 1


def test_compaction_with_a_filter_and_a_delete(spark):
    """The delete takes the oldest stored row, not one that the filter never let in."""
    query = mini_query(spark).add_neq_filter("a", "k", 9)
    work = ContinuousQuery(spark, query, {0: "a", 1: "b"}, {0: schema("k"), 1: schema("k")})
    work.on_report = lambda row, sample: None
    work.take(numbered(spark, ["0|9", "0|1", "0|2", "1|1", "1|2", "d 0 1", "-"]), 0)
    assert work.reported[-1]["n_seen"] == 1
    work.compact(7)
    assert sorted(r["line_no"] for r in work.log().collect()) == [2, 3, 4]
    work.take(spark.createDataFrame([(7, "-")], "line_no long, value string"), 1)
    assert work.reported[-1]["n_seen"] == 1


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(MINI[:8]) + "\n")
    work = ContinuousQuery(spark, mini_query(spark), {0: "a", 1: "b"}, {0: schema("k"), 1: schema("k")})
    work.on_report = lambda row, sample: None
    stream = work.start(spark.readStream.text(str(tmp_path / "in")))
    stream.awaitTermination(120)
    assert stream.exception() is None
    assert [r["n_seen"] for r in work.reported] == [4, 2]


def test_streamed_files_come_by_name(spark, tmp_path):
    """A small first file and a larger second one: the numbers of lines, and so deletes, follow the names."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("0|1\n0|2\n")
    (folder / "b.txt").write_text("\n".join(["d 0 1", *(["1|1", "1|2"] * 400), "-"]) + "\n")
    work = ContinuousQuery(spark, mini_query(spark), {0: "a", 1: "b"}, {0: schema("k"), 1: schema("k")})
    work.on_report = lambda row, sample: None
    work.start(spark.readStream.option("maxFilesPerTrigger", 2).text(str(folder))).awaitTermination(120)
    assert [(r["n_proc"], r["n_seen"], r["ntup"]) for r in work.reported] == [(400, 400, 803)]
    assert sorted(r["line_no"] for r in work.log().collect()) == list(range(804))


def test_end_of_input_holds_for_later_batches(spark):
    work = ContinuousQuery(spark, mini_query(spark), {0: "a", 1: "b"}, {0: schema("k"), 1: schema("k")})
    work.on_report = lambda row, sample: None
    lines = numbered(spark, ["0|1", "1|1", "-", "", "0|1", "0|1", "-"])
    work.take(lines.filter("line_no < 5"), 0)
    work.take(lines.filter("line_no >= 5"), 1)
    assert [r["n_seen"] for r in work.reported] == [1]
    work.take(lines.filter("line_no < 5"), 0)  # the batch itself may be repeated
    assert work.log().count() == 3


def test_late_rows(spark):
    """A row whose sliding window is over when it comes takes part in nothing; one that is late but within it counts."""
    q = JoinQuery().set_sliding_window(10)
    empty = spark.createDataFrame([], "line_no long, ts long, k long")
    for n in ("a", "b"):
        q.add_stream(n, empty, "line_no", ts="ts")
    q.add_equi_join("a", "k", "b", "k")
    work = ContinuousQuery(spark, q, {0: "a", 1: "b"}, {0: schema("ts k"), 1: schema("ts k")})
    work.on_report = lambda row, sample: None
    work.take(numbered(spark, ["0|100,1", "1|95,1", "-", "1|85,1", "0|105,1", "-", "0|200,1", "-"]), 0)
    assert [(r["n_proc"], r["n_seen"], r["win_lo"], r["win_hi"]) for r in work.reported] == [(1, 1, 91, 100), (0, 0, 96, 105), (0, 0, 191, 200)]


def test_whole_samples_are_dumped(spark, tmp_path, capsys):
    """A sample of 20 000 draws has 20 000 lines."""
    (tmp_path / "lines").write_text("\n".join(["0|0,1,0,50,0,1,0,3,10,0,0,0,0,0,0", "1|0,1,0,50,0,2,0,3,10,0,0,0,0,0,0", "-"]) + "\n")
    args = cli.parser().parse_args(["-q", "linear_road", "-i", str(tmp_path / "lines"), "-o", str(tmp_path / "o"), "-w", "tumbling", "-t", "60", "-s", "swr", "-r", "20000", "2", "5"])
    cli.run(args, spark)
    text = (tmp_path / "o").read_text()
    assert text.count("\nsample ") == 20_000 and "sample 0, ts = 1: 0 1" in text


def test_deletes_must_be_allowed(spark):
    work = ContinuousQuery(spark, mini_query(spark), {0: "a", 1: "b"}, {0: schema("k"), 1: schema("k")}, allow_deletes=False)
    work.on_report = lambda row, sample: None
    with pytest.raises(ValueError, match="deletes are not allowed"):
        work.take(numbered(spark, MINI), 0)


def test_report_text():
    assert report_line(1, None, None, 2, 3, 4) == "n_proc = 1, n_seen  = 2, ssize = 3, ntup = 4"
    assert report_line(1, 0, 59, 2, 3, 4) == "n_proc = 1, window [0, 59], n_seen  = 2, ssize = 3, ntup = 4"


def road(n):
    return [f"{i % 4 == 3 and 2 or 0},{i},{i},50,0,{1 + i % 3},{i % 5 == 4 and 1 or 0},3,{(i * 37) % 100},0,0,0,0,0,0" for i in range(n)]


def test_linear_road_end_to_end(spark, tmp_path, capsys):
    """Convert, run by command line, and compare each report with a replay."""
    raw = road(120)
    (tmp_path / "raw.csv").write_text("\n".join(raw) + "\n")
    cli.convert(["linear_road", str(tmp_path / "raw.csv"), str(tmp_path / "lines"), "0", "1", "3", "F", "30"], spark)
    lines = [r["value"] for r in read_lines(spark, str(tmp_path / "lines")).orderBy("line_no").collect()]
    want, edge = [], 30
    for x in raw:
        c = list(map(int, x.split(",")))
        if c[0] == 0 and c[6] == 0 and 1 <= c[5] <= 3:
            if c[1] >= edge:
                want.append("-")
                edge = (c[1] // 30 + 1) * 30
            want.append(f"{c[5] - 1}|{x}")
    want.append("-")
    assert lines == want
    args = cli.parser().parse_args(["-q", "linear_road", "-i", str(tmp_path / "lines"), "-o", str(tmp_path / "o"), "-m", str(tmp_path / "m"), "-w", "tumbling", "-t", "30", "-s", "swor", "-r", "5", "3", "10"])
    got = cli.run(args, spark)
    held, n, seen = {0: [], 1: [], 2: []}, -1, []
    for x in want:
        if x == "-":
            seen.append(sum(abs(a - b) <= 10 and abs(b - c) <= 10 for a in held[0] for b in held[1] for c in held[2]))
            continue
        sid, row = x.split("|")
        c = list(map(int, row.split(",")))
        if c[1] // 30 != n:
            n, held = c[1] // 30, {0: [], 1: [], 2: []}
        held[int(sid)].append(c[8])
    assert [r["n_seen"] for r in got] == seen
    assert (tmp_path / "o").read_text().startswith("n_proc = ") and (tmp_path / "m").read_text().count("\n") >= 1
    told = [list(map(float, x.split(","))) for x in (tmp_path / "m").read_text().splitlines()]
    assert sum(x[1] for x in told) == sum(r["ntup"] for r in got) and sum(x[2] for x in told) == sum(r["n_proc"] for r in got)


def test_exit_codes(tmp_path):
    assert cli.main(["-h"]) == 2
    assert cli.main(["-q", "nothing", "-i", "x"]) == 1


def tpcds(spark):
    """Tiny tables of the three queries."""
    rows = {
        "store_sales": [(1, i % 3, 0, i % 4, i % 5, 0, 0, 0, 0, 0, i, 1) for i in range(30)],
        "customer": [(1, i, f"c{i}", 0, i % 3 + 1) for i in range(1, 5)],
        "household_demographics": [(1, i, i % 2, "b", 0, 0) for i in range(1, 4)],
        "item": [(1, i, f"i{i}", None, None, "d", 1.0, 1.0, 0, "b", 0, "c", i % 2, "g", 128, "m") for i in range(4)],
    }
    kinds = {"store_sales": schemas.STORE_SALES.fields[:12], "customer": schemas.CUSTOMER.fields, "household_demographics": schemas.HOUSEHOLD_DEMOGRAPHICS.fields, "item": schemas.ITEM.fields}
    made = {n: spark.createDataFrame(r, type(schemas.ITEM)(list(kinds[n]))) for n, r in rows.items()}
    made["store_sales"] = converters.with_pair_key(made["store_sales"], "item_sk", "ticket_number", "item_sk_and_ticket_number")
    return made


@pytest.mark.parametrize("name", ["tpcds_qy", "tpcds_qz"])
def test_interleaved_queries(spark, name):
    t = tpcds(spark)
    if name == "tpcds_qy":
        lines = converters.qy_lines(t["store_sales"], t["customer"], t["household_demographics"], 5)
    else:
        lines = converters.qz_lines(t["store_sales"], t["customer"], t["item"], t["household_demographics"], 5)
    assert lines.filter("value = '-'").count() == 1
    log = parse_log(lines)
    frames = [parse_rows(log, i, s, null_as_zero=True) for i, (_, s) in enumerate(named.streams_of(name))]
    sizes = {a: named.build(name, frames, a).num_seen() for a in ("folded", "plain", "enumerate")}
    assert len(set(sizes.values())) == 1 and sizes["folded"] > 0


def test_returns_follow_their_sales(spark):
    t = tpcds(spark)
    returns = t["store_sales"].limit(10).select("time", F.lit(1).cast("long").alias("returned_date_sk"), *[F.lit(0).cast("long").alias(c) for c in ("return_time_sk",)], "item_sk", "customer_sk", *[F.lit(0).cast("long").alias(c) for c in ("cdemo_sk", "hdemo_sk", "addr_sk", "store_sk", "reason_sk")], "ticket_number", "item_sk_and_ticket_number")
    catalog = spark.createDataFrame([tuple([1, 1, 0, 0, i % 5, *[0] * 14]) for i in range(10)], schemas.CATALOG_SALES)
    dates = spark.createDataFrame([(1, i, "d", None, *[0] * 8) for i in range(3)], schemas.DATE_DIM)
    lines = converters.qx_lines(returns, catalog, dates, t["store_sales"], 7)
    log = parse_log(lines)
    at = {n: {r[s]: r["line_no"] for r in parse_rows(log, sid, kind).collect()} for n, sid, kind, s in (("ss", 4, schemas.STORE_SALES, "item_sk_and_ticket_number"), ("sr", 0, schemas.STORE_RETURNS, "item_sk_and_ticket_number"))}
    assert len(at["sr"]) == 10 and all(at["sr"][k] > at["ss"][k] for k in at["sr"])


def test_delete_workload(spark):
    t = tpcds(spark)
    many = t["store_sales"].crossJoin(spark.range(210)).drop("id").withColumn("ticket_number", F.monotonically_increasing_id())
    lines = converters.qy_lines(many, t["customer"], t["household_demographics"], 5, deletes=True)
    assert [r["value"] for r in lines.filter(F.col("value").startswith("d ")).collect()] == ["d 0 600", "d 0 600"]


def test_dat_files(spark, tmp_path):
    (tmp_path / "customer.dat").write_text("1|AAA|5||9|x|\n2|BBB||7|\n")
    got = sorted(tuple(r) for r in read_dat(spark, str(tmp_path / "customer.dat"), schemas.CUSTOMER).collect())
    assert got == [(1, 1, "AAA", 5, None), (1, 2, "BBB", None, 7)]


def test_edgar(spark):
    log = spark.createDataFrame([(0, "1.2.3.abc", datetime.date(2020, 1, 1), "00:00:10")], "line_no long, ip string, date date, time string")
    octets = spark.createDataFrame([("abc", 7)], "code string, octet int")
    rows = sorted(converters.edgar(log, octets).collect(), key=lambda r: r["sid"])
    assert [r["ts"] - r["original_ts"] for r in rows] == [0, 1, 2]
    assert rows[0]["ip24"] == (1 << 16) + (2 << 8) + 3 and rows[0]["ip"] == rows[0]["ip24"] * 256 + 7
