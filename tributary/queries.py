"""The registered queries over the generated tables, each with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary import named
from tributary.operators import reports, sampling
from tributary.operators.tables import arrival
from tributary.query import JoinQuery
from tributary.sources import converters
from tributary.sources.schemas import schema
from tributary.sources.tagged import csv_of, parse_log, parse_rows

SEED = 19950810
LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
LINE_SQL = "concat_ws('|', {0}.l_orderkey, {0}.l_linenumber, {0}.l_partkey, {0}.l_suppkey, strftime({0}.l_shipdate, '%Y-%m-%d %H:%M:%S'))"
EVENT_TYPES = ("view", "click", "purchase")
#: For repairs, how many of the oldest views and clicks have gone at each; for reports, (stream, type, after every so many, so many).
REPAIRS = [(300, 100), (500, 250)]
DELETES = [(0, "view", 300, 60), (1, "click", 100, 20)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qx(spark: SparkSession, d: str, algorithm: str = "folded") -> JoinQuery:
    """Returned and accepted lines of one supplier, with order and part."""
    lines = read(spark, d, "lineitem")
    q = JoinQuery(algorithm).add_stream("lr", lines, LINE).add_stream("la", lines, LINE)
    q.add_stream("o", read(spark, d, "orders"), "o_orderkey", primary_key="o_orderkey").add_stream("p", read(spark, d, "part"), "p_partkey", primary_key="p_partkey")
    q.add_equi_join("lr", "l_orderkey", "o", "o_orderkey", foreign_key="lr").add_equi_join("la", "l_partkey", "p", "p_partkey", foreign_key="la")
    q.add_equi_join("lr", "l_suppkey", "la", "l_suppkey")
    return q.add_equi_filter("lr", "l_returnflag", "R").add_equi_filter("la", "l_returnflag", "A")


def qy(spark: SparkSession, d: str, algorithm: str = "folded") -> JoinQuery:
    """Lines with their customer, and customers of the same nation."""
    customers = read(spark, d, "customer")
    q = JoinQuery(algorithm).add_stream("l", read(spark, d, "lineitem"), LINE).add_stream("c2", customers, "c_custkey")
    q.add_stream("o", read(spark, d, "orders"), "o_orderkey", primary_key="o_orderkey").add_stream("c1", customers, "c_custkey", primary_key="c_custkey")
    q.add_equi_join("l", "l_orderkey", "o", "o_orderkey", foreign_key="l").add_equi_join("o", "o_custkey", "c1", "c_custkey", foreign_key="o")
    return q.add_equi_join("c1", "c_nationkey", "c2", "c_nationkey")


def qz(spark: SparkSession, d: str) -> JoinQuery:
    """The same, and parts of the line's part's size."""
    parts = read(spark, d, "part")
    q = qy(spark, d).add_stream("p1", parts, "p_partkey", primary_key="p_partkey").add_stream("p2", parts, "p_partkey")
    return q.add_equi_join("l", "l_partkey", "p1", "p_partkey", foreign_key="l").add_equi_join("p1", "p_size", "p2", "p_size")


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events with ts in whole seconds."""
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)").cast("long")
    return read(spark, d, "events").select("event_id", "user_id", "event_type", seconds.alias("ts"))


def lanes(spark: SparkSession, d: str, width: int = 1, n: int = 3, algorithm: str = "folded") -> JoinQuery:
    """Events of the three types as lanes, joined over a band of users."""
    rows, q = events(spark, d), JoinQuery(algorithm)
    for kind in EVENT_TYPES[:n]:
        q.add_stream(kind, rows, "event_id", ts="ts").add_equi_filter(kind, "event_type", kind)
    for a, b in zip(EVENT_TYPES, EVENT_TYPES[1:n]):
        q.add_band_join(a, "user_id", b, "user_id", width)
    return q


def count_qx(spark, d):
    return qx(spark, d).count_frame()


def count_qy(spark, d):
    return qy(spark, d).count_frame()


def count_qz(spark, d):
    return qz(spark, d).count_frame()


def count_linear_road(spark, d):
    return lanes(spark, d).set_tumbling_window(86400).count_frame().agg(F.coalesce(F.sum("n_seen"), F.lit(0)).alias("n_seen"))


def row_weights_qy(spark, d):
    return qy(spark, d).row_weights()


def filter_equi(spark, d):
    """All streams fold into one table, so its rows are the results."""
    q = JoinQuery().add_stream("l", read(spark, d, "lineitem"), LINE).add_stream("o", read(spark, d, "orders"), "o_orderkey", primary_key="o_orderkey")
    q.add_stream("p", read(spark, d, "part"), "p_partkey", primary_key="p_partkey").add_equi_join("l", "l_orderkey", "o", "o_orderkey", foreign_key="l")
    return q.add_equi_join("l", "l_partkey", "p", "p_partkey", foreign_key="l").add_equi_filter("p", "p_size", 12).count_frame()


def filter_neq(spark, d):
    return qy(spark, d).add_neq_filter("c2", "c_mktsegment", "BUILDING").count_frame()


def filter_band(spark, d):
    return qz(spark, d).add_band_filter("p2", "p_size", 25, 5).count_frame()


def band_join_2way(spark, d):
    return lanes(spark, d, 3, 2).count_frame()


def band_join_wide(spark, d):
    """A band that half of all users lie in."""
    return lanes(spark, d, 5000, 2).count_frame()


def fk_fold_count(spark, d):
    return qy(spark, d).count_frame(trust_keys=True)


def fk_untrusted_count(spark, d):
    """References that lead to filtered rows have no result."""
    return qx(spark, d).add_neq_filter("o", "o_orderstatus", "F").count_frame()


def self_join_count(spark, d):
    customers = read(spark, d, "customer")
    return JoinQuery().add_stream("a", customers, "c_custkey").add_stream("b", customers, "c_custkey").add_equi_join("a", "c_nationkey", "b", "c_nationkey").count_frame()


def some_qy(spark, d, algorithm="enumerate"):
    q = qy(spark, d, algorithm).add_equi_filter("l", "l_returnflag", "R").add_equi_filter("l", "l_linestatus", "F")
    return q.add_equi_filter("c2", "c_mktsegment", "BUILDING").add_equi_filter("o", "o_orderpriority", "1-URGENT")


def enumerate_qy_filtered(spark, d):
    return some_qy(spark, d).results()


def enumerate_neighbours(spark, d):
    """All pairs of customers of one nation, with the nation: a whole join that is small enough to make."""
    customers = read(spark, d, "customer")
    q = JoinQuery("enumerate").add_stream("a", customers, "c_custkey").add_stream("n", read(spark, d, "nation"), "n_nationkey", primary_key="n_nationkey").add_stream("b", customers, "c_custkey")
    return q.add_equi_join("a", "c_nationkey", "n", "n_nationkey", foreign_key="a").add_equi_join("n", "n_nationkey", "b", "c_nationkey").results()


def unrank_qy(spark, d):
    q = qy(spark, d)
    size = q.num_seen()
    return q.by_numbers([sampling.md5_number(7, i) % size for i in range(300)])


def bernoulli_qy(spark, d):
    """All of QY, by result numbers."""
    return qy(spark, d).set_bernoulli_sampling(0.0001, seed=SEED, deterministic=True).samples().drop("draw")


def swor_qy(spark, d):
    return qy(spark, d).set_sampling_without_replacement(200, deterministic=True).samples()


def swr_qy(spark, d):
    return qy(spark, d).set_sampling_with_replacement(200, deterministic=True).samples()


def bottomk_swor_qx(spark, d):
    return qx(spark, d, "enumerate").set_sampling_without_replacement(100, seed=SEED).samples().drop("draw")


def tumbling_count(spark, d):
    return lanes(spark, d).set_tumbling_window(86400).count_frame()


def tumbling_swor(spark, d):
    return lanes(spark, d).set_tumbling_window(864000).set_sampling_without_replacement(20, deterministic=True).samples()


def sliding_live_count(spark, d):
    return lanes(spark, d).set_sliding_window(432000).live().count_frame()


def sliding_swor(spark, d):
    return lanes(spark, d).set_sliding_window(864000).set_sampling_without_replacement(20, deterministic=True).samples()


def result_ts(spark, d):
    return lanes(spark, d, algorithm="enumerate").set_tumbling_window(86400).results().drop("last_ts")


def pairs(spark, d):
    """Views and clicks over a band of users, rows of other types left out."""
    rows, q = events(spark, d), JoinQuery()
    for kind in EVENT_TYPES[:2]:
        q.add_stream(kind, rows.filter(F.col("event_type") == kind), "event_id", ts="ts")
    return q.add_band_join("view", "user_id", "click", "user_id", 1)


def deleted(spark, d, views=300, clicks=100):
    return pairs(spark, d).after_deletes({k: "event_id" for k in EVENT_TYPES[:2]}, {"view": views, "click": clicks})


def fifo_delete_count(spark, d):
    return deleted(spark, d).count_frame()


def fifo_delete_swor(spark, d):
    return deleted(spark, d).set_sampling_without_replacement(50, deterministic=True).samples()


def repaired_twice(spark, d, method):
    """A sample over two deletes that follow each other, repaired after each."""
    sample = getattr(pairs(spark, d), method)(50, deterministic=True).samples()
    for nth, (views, clicks) in enumerate(REPAIRS, 1):
        sample = getattr(deleted(spark, d, views, clicks), method)(50, deterministic=True).repaired(sample, nth)
    return sample


def repair_swor(spark, d):
    return repaired_twice(spark, d, "set_sampling_without_replacement").drop("draw")


def repair_swr(spark, d):
    return repaired_twice(spark, d, "set_sampling_with_replacement")


def reported(spark, rows, deletes, marks, window=None):
    """Reports over views and clicks as one log; rows: with line_no; deletes: (line_no, sid, n); marks: line numbers."""
    sids = {0: "view", 1: "click"}
    inserts = rows.select("line_no", F.lit("insert").alias("kind"), F.when(F.col("event_type") == "view", 0).otherwise(1).alias("sid"), F.lit(None).cast("long").alias("n"))
    lines = spark.createDataFrame([(m, "report", None, None) for m in marks], "line_no long, kind string, sid int, n long")
    q, frames = JoinQuery(), {}
    for kind in sids.values():
        frames[kind] = rows.filter(F.col("event_type") == kind).select("line_no", "event_id", "user_id", "ts")
        q.add_stream(kind, frames[kind], "event_id", ts="ts")
    q.add_band_join("view", "user_id", "click", "user_id", 1)
    if window:
        q.set_sliding_window(window)
    log = inserts.unionByName(lines).unionByName(deletes.select("line_no", F.lit("delete").alias("kind"), "sid", "n")) if deletes is not None else inserts.unionByName(lines)
    return reports.report_rows(q.spec, log, frames, sids, lambda n: min(n, 100))


def report_rows_deletes(spark, d):
    """As report_rows, with deletes of the 60 oldest views after every 300, and of the 20 oldest clicks after every 100."""
    rows = events(spark, d).filter(F.col("event_type").isin(*EVENT_TYPES[:2])).withColumn("line_no", F.col("event_id") * 4 + 1)
    top = rows.agg(F.max("event_id")).first()[0] or 0
    deletes = None
    for sid, kind, every, n in DELETES:
        own = arrival(rows.filter(F.col("event_type") == kind).select("line_no"), [], "line_no").filter((F.col("_idx") + 1) % every == 0)
        own = own.select((F.col("line_no") + 1).alias("line_no"), F.lit(sid).alias("sid"), F.lit(n).cast("long").alias("n"))
        deletes = own if deletes is None else deletes.unionByName(own)
    return reported(spark, rows, deletes, [4 * ((top * i) // 4 + 1) for i in range(1, 5)]).drop("win_lo", "win_hi")


def report_rows_sliding(spark, d):
    """Views and clicks in the order of their times, in a sliding window."""
    rows = events(spark, d).filter(F.col("event_type").isin(*EVENT_TYPES[:2])).withColumn("line_no", (F.col("ts") * (1 << 32) + F.col("event_id")) * 2 + 1)
    top = rows.agg(F.max("ts")).first()[0] or 0
    return reported(spark, rows, None, [2 * (((top * i) // 4 + 1) << 32) for i in range(1, 5)], 43200)


def report_rows(spark, d):
    """Views and clicks as one log with four markers, reported at each."""
    rows = events(spark, d).filter(F.col("event_type").isin(*EVENT_TYPES[:2])).withColumn("line_no", F.col("event_id") * 2 + 1)
    top = rows.agg(F.max("event_id")).first()[0] or 0
    sids = {0: "view", 1: "click"}
    inserts = rows.select("line_no", F.lit("insert").alias("kind"), F.when(F.col("event_type") == "view", 0).otherwise(1).alias("sid"), F.lit(None).cast("long").alias("n"))
    marks = spark.createDataFrame([(2 * ((top * i) // 4 + 1), "report", None, None) for i in range(1, 5)], "line_no long, kind string, sid int, n long")
    q, frames = JoinQuery(), {}
    for sid, kind in sids.items():
        frames[kind] = rows.filter(F.col("event_type") == kind).select("line_no", "event_id", "user_id", "ts")
        q.add_stream(kind, frames[kind], "event_id")
    q.add_band_join("view", "user_id", "click", "user_id", 1)
    return reports.report_rows(q.spec, inserts.unionByName(marks), frames, sids, lambda n: min(n, 100)).drop("win_lo", "win_hi")


def added_count_qy(spark, d):
    """What further lines and customers would add to the join, without counting old results again."""
    q = qy(spark, d)
    lines, customers = q.spec.streams["l"].frame, q.spec.streams["c2"].frame
    old = q._with(q.spec.over({"l": lines.filter("l_linenumber <= 3"), "c2": customers.filter("c_custkey % 5 != 0")}))
    n = old.added({"l": lines.filter("l_linenumber > 3"), "c2": customers.filter("c_custkey % 5 = 0")})
    return spark.createDataFrame([(n,)], "n_added long")


def key_problems_qx(spark, d):
    """References into filtered tables that find nothing."""
    q = qx(spark, d).add_equi_filter("p", "p_size", 12)
    return q.key_problems(1 << 30).groupBy("problem", "stream").agg(F.count("*").alias("n_keys"))


def resolve_samples(spark, d):
    q = qy(spark, d).set_sampling_without_replacement(100, deterministic=True)
    out = q.samples({"l": ["l_quantity"], "o": ["o_orderpriority"], "c1": ["c_name", "c_nationkey"], "c2": ["c_name", "c_nationkey"]})
    return out.select("draw", "l_l_quantity", "o_o_orderpriority", "c1_c_name", "c2_c_name", "c1_c_nationkey", "c2_c_nationkey")


def cumulative_n_proc(spark, d):
    """Results that a sliding window has ever held."""
    return lanes(spark, d, algorithm="enumerate").set_sliding_window(43200).results().agg(F.count("*").alias("n_proc"))


def tumbling_bernoulli_ts(spark, d):
    """One in a thousand of the last window's results, with their times."""
    return lanes(spark, d).set_tumbling_window(864000).set_bernoulli_sampling(0.001, seed=SEED, deterministic=True).samples(with_ts=True).drop("draw")


def parsed_orders(spark, d):
    """Orders as tagged lines, and back."""
    rows = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("o_orderdate"), "o_orderpriority")
    lines = rows.select(F.col("o_orderkey").alias("line_no"), F.concat(F.lit("0|"), csv_of(rows)).alias("value"))
    kinds = schema("o_orderkey o_custkey o_orderstatus:string o_orderdate:date o_orderpriority:string")
    return parse_rows(parse_log(lines), 0, kinds, widths={"o_orderpriority": 8})


def lines_after(spark, d):
    """Nations first, then orders and lines of orders at random, a line after its order."""
    nations, orders = read(spark, d, "nation").select("n_nationkey", "n_name"), read(spark, d, "orders").select("o_orderkey", "o_custkey")
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return converters.interleave([(2, nations)], [(1, orders), (0, lines)], 7, after=(0, ["l_orderkey"], 1, ["o_orderkey"]))


def lines_deletes(spark, d):
    """Nations first, then lines of orders and customers at random, with deletes after every so many of each."""
    nations, customers = read(spark, d, "nation").select("n_nationkey", "n_name"), read(spark, d, "customer").select("c_custkey", "c_nationkey")
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return converters.interleave([(2, nations), (3, nations)], [(1, customers), (0, lines)], 7, deletes=converters.QY_DELETES, report_every=10_000)


def road_lines(spark, d):
    """Events as position reports: lanes by type, a direction by user, times in hours."""
    rows = events(spark, d).withColumn("lane", F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).otherwise(3))
    value = F.concat_ws(",", F.lit("0"), F.floor(F.col("ts") / 3600).cast("string"), F.col("user_id").cast("string"))
    made = rows.select(F.col("event_id").alias("line_no"), value.alias("value"), F.lit(0).alias("type"), (F.col("user_id") % 2).cast("int").alias("dir"), "lane", F.floor(F.col("ts") / 3600).cast("long").alias("time"))
    return converters.linear_road(made, 0, 1, 2, "F", 24)


def edgar_rows(spark, d):
    """Events as access-log rows."""
    rows = events(spark, d).select(
        F.col("event_id").alias("line_no"), F.concat(F.lit("10."), (F.col("user_id") % 5).cast("string"), F.lit("."), (F.col("user_id") % 250).cast("string"), F.lit(".c"), (F.col("event_id") % 7).cast("string")).alias("ip"),
        F.expr("date_add(date'2024-01-01', cast(ts div 86400 as int))").alias("date"), F.expr("date_format(timestamp_seconds(ts % 86400), 'HH:mm:ss')").alias("time"),
    )
    octets = spark.sql("SELECT concat('c', id) AS code, CAST(id * 11 AS int) AS octet FROM range(7)")
    return converters.edgar(rows, octets).select("line_no", "sid", "ts", "original_ts", "ip", "ip24")


def edgar_count(spark, d):
    """The join of an access log with itself, a second and two later, over addresses of one net, in tumbling windows."""
    rows = edgar_rows(spark, d)
    q = named.build("edgar", [rows.filter(F.col("sid") == i) for i in range(3)])
    return q.set_tumbling_window(3600).count_frame()


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return resolve_samples(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        count_qx, count_qy, count_qz, count_linear_road, row_weights_qy, filter_equi, filter_neq, filter_band, band_join_2way, band_join_wide, fk_fold_count,
        fk_untrusted_count, self_join_count, enumerate_qy_filtered, enumerate_neighbours, unrank_qy, bernoulli_qy, swor_qy, swr_qy, bottomk_swor_qx,
        tumbling_count, tumbling_swor, tumbling_bernoulli_ts, sliding_live_count, sliding_swor, result_ts, fifo_delete_count, fifo_delete_swor,
        repair_swor, repair_swr, report_rows, report_rows_deletes, report_rows_sliding, added_count_qy, key_problems_qx, resolve_samples, cumulative_n_proc,
        parsed_orders, lines_after, lines_deletes, road_lines, edgar_rows, edgar_count,
    )
    return {f.__name__: f for f in found}


# The SQL. It makes every join in full, so it owes nothing to weights.

QX_FROM = "lineitem lr JOIN orders o ON lr.l_orderkey = o.o_orderkey JOIN lineitem la ON lr.l_suppkey = la.l_suppkey JOIN part p ON la.l_partkey = p.p_partkey WHERE lr.l_returnflag = 'R' AND la.l_returnflag = 'A'"
QY_FROM = "lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c1 ON o.o_custkey = c1.c_custkey JOIN customer c2 ON c1.c_nationkey = c2.c_nationkey"
QZ_FROM = QY_FROM + " JOIN part p1 ON l.l_partkey = p1.p_partkey JOIN part p2 ON p1.p_size = p2.p_size"
COUNT = "SELECT CAST(count(*) AS BIGINT) AS n_seen FROM "
SOME = "WHERE l.l_returnflag = 'R' AND l.l_linestatus = 'F' AND c2.c_mktsegment = 'BUILDING' AND o.o_orderpriority = '1-URGENT'"
EVENTS = "ev AS (SELECT event_id, user_id, event_type, date_diff('second', TIMESTAMP '2024-01-01', ts) AS ts FROM events)"
LANES = "ev v JOIN ev c ON c.event_type = 'click' AND abs(v.user_id - c.user_id) <= 1 JOIN ev p ON p.event_type = 'purchase' AND abs(c.user_id - p.user_id) <= 1"
QY_RIDS = f"{LINE_SQL.format('l')} AS l_rid, CAST(c2.c_custkey AS VARCHAR) AS c2_rid, CAST(o.o_orderkey AS VARCHAR) AS o_rid, CAST(c1.c_custkey AS VARCHAR) AS c1_rid"


def number(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


QY_ALL = f"""
a AS (SELECT *, row_number() OVER (ORDER BY {number('l_rid')}, l_rid, {number('c2_rid')}, c2_rid) - 1 AS j FROM (SELECT {QY_RIDS} FROM {QY_FROM}) t),
n AS (SELECT count(*) AS n FROM a)"""


def swor_draws(k: int, seed: int = SEED) -> str:
    """(draw, j) of a sample without replacement, for n results: see draw_numbers()."""
    return f"""
raw AS (SELECT i, {number(f"'{seed}|' || i")} % n AS j FROM n, range({4 * k + 256}) r(i) WHERE n > 0),
few AS (SELECT row_number() OVER (ORDER BY CASE WHEN n > {k} THEN {number(f"'{seed}|' || j")} END, j) - 1 AS draw, j FROM n, LATERAL (SELECT unnest(range(CASE WHEN n <= {2 * k} THEN n ELSE 0 END)) AS j) t),
many AS (SELECT row_number() OVER (ORDER BY i) - 1 AS draw, j FROM (SELECT j, min(i) AS i FROM raw GROUP BY j) t WHERE (SELECT n FROM n) > {2 * k}),
draws AS (SELECT * FROM (SELECT * FROM few UNION ALL SELECT * FROM many) t WHERE draw < {k})"""


def bernoulli_draws(rate: float, seed: int = SEED, each: int = 50_000) -> str:
    """(j) of a Bernoulli sample of n results, by gaps: see bernoulli_numbers()."""
    uniform = f"({number(f"'{seed}|' || b || '|' || i")} + 0.5::DOUBLE) / {2**60}"
    return f"""
blocks AS (SELECT n, greatest(1, CAST(floor(n * {rate}::DOUBLE / {each}) AS BIGINT)) AS k FROM n WHERE n > 0),
steps AS (SELECT n, k, (n + k - 1) // k AS step FROM blocks),
gaps AS (
  SELECT n, step, b, i, 1 + CAST(floor(ln({uniform}) / ln(1 - {rate}::DOUBLE)) AS BIGINT) AS gap
  FROM (SELECT n, step, unnest(range(k)) AS b FROM steps) t, LATERAL (SELECT unnest(range(CAST(2 * step * {rate}::DOUBLE AS BIGINT) + 1000)) AS i) u),
draws AS (
  SELECT j FROM (SELECT n, step, b, b * step - 1 + sum(gap) OVER (PARTITION BY b ORDER BY i) AS j FROM gaps) t WHERE j < least(n, (b + 1) * step))"""


def repairs_sql(kind: str, k: int = 50) -> str:
    """A sample of pairs, and its repair after each of REPAIRS: see repaired()."""
    rid = lambda t: f"CAST({t}.event_id AS VARCHAR)"
    order = f"{number(rid('v'))}, {rid('v')}, c.user_id, {number(rid('c'))}, {rid('c')}"
    parts = [
        """vw AS (SELECT *, row_number() OVER (ORDER BY event_id) AS k FROM events WHERE event_type = 'view'),
cl AS (SELECT *, row_number() OVER (ORDER BY event_id) AS k FROM events WHERE event_type = 'click')"""
    ]
    for i, (views, clicks) in enumerate([(0, 0), *REPAIRS]):
        parts.append(
            f"""a{i} AS (SELECT {rid('v')} AS view_rid, {rid('c')} AS click_rid, row_number() OVER (ORDER BY {order}) - 1 AS j FROM vw v JOIN cl c ON abs(v.user_id - c.user_id) <= 1 WHERE v.k > {views} AND c.k > {clicks}),
n{i} AS (SELECT count(*) AS n FROM a{i})"""
        )
        if i:
            parts.append(
                f"""left{i} AS (SELECT * FROM s{i - 1} SEMI JOIN a{i} USING (view_rid, click_rid)),
seed{i} AS (SELECT n, kept, {number(f"'{SEED}|repair|{i}|' || n || '|' || kept")} AS seed FROM n{i}, (SELECT count(*) AS kept FROM left{i}) t)"""
            )
        else:
            parts.append(f"seed0 AS (SELECT n, 0 AS kept, {SEED} AS seed FROM n0)")
        if kind == "swr":
            slots = f"SELECT s AS draw, row_number() OVER (ORDER BY s) - 1 AS i FROM range({k}) t(s) WHERE s NOT IN (SELECT draw FROM left{i})" if i else f"SELECT s AS draw, s AS i FROM range({k}) t(s)"
            fresh = f"SELECT draw, view_rid, click_rid FROM (SELECT draw, {number("seed || '|' || i")} % n AS j FROM ({slots}) t, seed{i} WHERE n > 0) t JOIN a{i} USING (j)"
        else:
            parts.append(f"raw{i} AS (SELECT i, {number("seed || '|' || i")} % n AS j FROM seed{i}, range({4 * k + 256}) r(i) WHERE n > 0)")
            parts.append(f"many{i} AS (SELECT j, row_number() OVER (ORDER BY min(i)) - 1 AS draw FROM raw{i} GROUP BY j)")
            drawn = f"SELECT {i * 1000} + draw AS draw, view_rid, click_rid FROM many{i} JOIN a{i} USING (j) WHERE draw < {k}"
            fresh = f"SELECT * FROM (SELECT * FROM ({drawn}) t ANTI JOIN left{i} USING (view_rid, click_rid)) t ORDER BY draw LIMIT (SELECT least({k}, n) - kept FROM seed{i})" if i else drawn
        parts.append(f"s{i} AS (SELECT draw, view_rid, click_rid FROM ({fresh}) t{f' UNION ALL SELECT draw, view_rid, click_rid FROM left{i}' if i else ''})")
    return f"WITH {', '.join(parts)} SELECT {'CAST(draw AS BIGINT) AS draw, ' if kind == 'swr' else ''}view_rid, click_rid FROM s{len(REPAIRS)}"


def interleaved_sql(first: list[tuple[int, str, str]], mixed: list[tuple[int, str, str]], seed: int, report_every: int, deletes: dict[int, tuple[int, int]]) -> str:
    """The lines of interleave(); streams as (number, FROM clause, csv), a child row with its parent's csv and number as pcsv, psid."""
    place = lambda sid, csv: number(f"'{seed}|{sid}|' || {csv}")
    rows = [f"SELECT {block} AS block, {sid} AS sid, csv, {place(sid, 'csv')} AS key, 0 AS late, {place(sid, 'csv')} AS tie FROM (SELECT {csv} AS csv FROM {table}) t" for block, (sid, table, csv) in enumerate(first)]
    for sid, table, csv in mixed:
        own, parent = place(sid, "csv"), place("' || psid || '", "pcsv")
        rows.append(
            f"SELECT {len(first)}, {sid}, csv, CASE WHEN pcsv IS NULL THEN {own} ELSE greatest({own}, {parent}) END, CASE WHEN {parent} >= {own} THEN 1 ELSE 0 END, {own} "
            f"FROM (SELECT {csv if ' AS ' in csv else csv + ' AS csv, NULL::VARCHAR AS pcsv, NULL::VARCHAR AS psid'} FROM {table}) t"
        )
    out = f"""WITH l AS ({' UNION ALL '.join(rows)}),
n AS (SELECT row_number() OVER (ORDER BY block, key, late, tie, sid, csv) - 1 AS n, block, sid, csv FROM l)
SELECT n * 4 + 1 AS line_no, sid || '|' || csv AS value FROM n UNION ALL SELECT n * 4, '-' FROM n WHERE n % {report_every} = 0"""
    for sid, (every, k) in deletes.items():
        out += f" UNION ALL SELECT n * 4 + 2, 'd {sid} {k}' FROM (SELECT n, row_number() OVER (ORDER BY n) AS i FROM n WHERE sid = {sid} AND block = {len(first)}) t WHERE i % {every} = 0"
    return out


def lanes_all(where: str) -> str:
    """All results of three lanes in the order of their numbers."""
    rid = lambda t: f"CAST({t}.event_id AS VARCHAR)"
    order = f"{number(rid('v'))}, {rid('v')}, c.user_id, {number(rid('c'))}, {rid('c')}, p.user_id, {number(rid('p'))}, {rid('p')}"
    return f"""
a AS (SELECT {rid('v')} AS view_rid, {rid('c')} AS click_rid, {rid('p')} AS purchase_rid, least(v.ts, c.ts, p.ts) AS result_ts, row_number() OVER (ORDER BY {order}) - 1 AS j
  FROM {LANES} WHERE v.event_type = 'view' AND {where}),
n AS (SELECT count(*) AS n FROM a)"""


TOP = "(SELECT max(ts) FROM ev WHERE event_type IN ('view', 'click', 'purchase'))"
IN_TUMBLING = " AND ".join(f"floor({t}.ts / 864000) = floor({TOP} / 864000)" for t in "vcp")
IN_SLIDING = " AND ".join(f"{t}.ts BETWEEN {TOP} - 863999 AND {TOP}" for t in "vcp")
EDGAR_ROWS = """
el AS (SELECT event_id, CAST(epoch(TIMESTAMP '2024-01-01') AS BIGINT) + ts AS t, CAST(10 * 65536 + (user_id % 5) * 256 + user_id % 250 AS INTEGER) AS ip24, (event_id % 7) * 11 AS octet FROM ev),
er AS (SELECT event_id AS line_no, CAST(s AS INTEGER) AS sid, t + s AS ts, t AS original_ts, CAST(ip24 AS BIGINT) * 256 + octet AS ip, ip24 FROM el, range(3) r(s))"""
DELETED = """
vw AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS k FROM events WHERE event_type = 'view') t WHERE k > 300),
cl AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS k FROM events WHERE event_type = 'click') t WHERE k > 100)"""


def oracle_sql() -> dict[str, str]:
    rid = lambda t: f"CAST({t}.event_id AS VARCHAR)"
    swor_lanes = "SELECT draw, view_rid, click_rid, purchase_rid FROM draws JOIN a USING (j)"
    return {
        "count_qx": COUNT + QX_FROM,
        "count_qy": COUNT + QY_FROM,
        "count_qz": COUNT + QZ_FROM,
        "count_linear_road": f"WITH {EVENTS} {COUNT} {LANES} WHERE v.event_type = 'view' AND v.ts // 86400 = c.ts // 86400 AND c.ts // 86400 = p.ts // 86400",
        "row_weights_qy": f"SELECT {LINE_SQL.format('l')} AS rid, CAST(count(*) AS BIGINT) AS weight FROM {QY_FROM} GROUP BY 1",
        "filter_equi": COUNT + "lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey WHERE p.p_size = 12",
        "filter_neq": COUNT + QY_FROM + " WHERE c2.c_mktsegment <> 'BUILDING'",
        "filter_band": COUNT + QZ_FROM + " WHERE abs(p2.p_size - 25) <= 5",
        "band_join_2way": f"WITH {EVENTS} {COUNT} ev v JOIN ev c ON c.event_type = 'click' AND abs(v.user_id - c.user_id) <= 3 WHERE v.event_type = 'view'",
        "fk_fold_count": COUNT + QY_FROM,
        "fk_untrusted_count": COUNT + QX_FROM + " AND o.o_orderstatus <> 'F'",
        "self_join_count": COUNT + "customer a JOIN customer b ON a.c_nationkey = b.c_nationkey",
        "enumerate_qy_filtered": f"SELECT {QY_RIDS} FROM {QY_FROM} {SOME}",
        "enumerate_neighbours": "SELECT CAST(a.c_custkey AS VARCHAR) AS a_rid, CAST(n.n_nationkey AS VARCHAR) AS n_rid, CAST(b.c_custkey AS VARCHAR) AS b_rid FROM customer a JOIN nation n ON a.c_nationkey = n.n_nationkey JOIN customer b ON n.n_nationkey = b.c_nationkey",
        "unrank_qy": f"WITH {QY_ALL} SELECT CAST(i AS BIGINT) AS draw, l_rid, c2_rid, o_rid, c1_rid FROM (SELECT i, {number("'7|' || i")} % n AS j FROM n, range(300) r(i)) d JOIN a USING (j)",
        "bernoulli_qy": f"WITH {QY_ALL}, {bernoulli_draws(0.0001)} SELECT l_rid, c2_rid, o_rid, c1_rid FROM draws JOIN a USING (j)",
        "tumbling_bernoulli_ts": f"WITH {EVENTS}, {lanes_all(IN_TUMBLING)}, {bernoulli_draws(0.001)} SELECT view_rid, click_rid, purchase_rid, result_ts FROM draws JOIN a USING (j)",
        "band_join_wide": f"WITH {EVENTS} {COUNT} ev v JOIN ev c ON c.event_type = 'click' AND abs(v.user_id - c.user_id) <= 5000 WHERE v.event_type = 'view'",
        "repair_swor": repairs_sql("swor"),
        "repair_swr": repairs_sql("swr"),
        "swor_qy": f"WITH {QY_ALL}, {swor_draws(200)} SELECT draw, l_rid, c2_rid, o_rid, c1_rid FROM draws JOIN a USING (j)",
        "swr_qy": f"WITH {QY_ALL} SELECT CAST(i AS BIGINT) AS draw, l_rid, c2_rid, o_rid, c1_rid FROM (SELECT i, {number(f"'{SEED}|' || i")} % n AS j FROM n, range(200) r(i)) d JOIN a USING (j)",
        "bottomk_swor_qx": f"""SELECT lr_rid, la_rid, o_rid, p_rid FROM (
  SELECT {LINE_SQL.format('lr')} AS lr_rid, {LINE_SQL.format('la')} AS la_rid, CAST(o.o_orderkey AS VARCHAR) AS o_rid, CAST(p.p_partkey AS VARCHAR) AS p_rid
  FROM {QX_FROM}) t ORDER BY md5(concat_ws('|', '{SEED}', lr_rid, la_rid, o_rid, p_rid)), lr_rid, la_rid, o_rid, p_rid LIMIT 100""",
        "tumbling_count": f"WITH {EVENTS} SELECT v.ts // 86400 AS \"window\", CAST(count(*) AS BIGINT) AS n_seen FROM {LANES} WHERE v.event_type = 'view' AND v.ts // 86400 = c.ts // 86400 AND c.ts // 86400 = p.ts // 86400 GROUP BY 1",
        "tumbling_swor": f"WITH {EVENTS}, {lanes_all(IN_TUMBLING)}, {swor_draws(20)} {swor_lanes}",
        "sliding_live_count": f"WITH {EVENTS} {COUNT} {LANES} WHERE v.event_type = 'view' AND {IN_SLIDING.replace('863999', '431999')}",
        "sliding_swor": f"WITH {EVENTS}, {lanes_all(IN_SLIDING)}, {swor_draws(20)} {swor_lanes}",
        "result_ts": f"WITH {EVENTS} SELECT {rid('v')} AS view_rid, {rid('c')} AS click_rid, {rid('p')} AS purchase_rid, least(v.ts, c.ts, p.ts) AS result_ts FROM {LANES} WHERE v.event_type = 'view' AND v.ts // 86400 = c.ts // 86400 AND c.ts // 86400 = p.ts // 86400",
        "fifo_delete_count": f"WITH {DELETED} {COUNT} vw v JOIN cl c ON abs(v.user_id - c.user_id) <= 1",
        "fifo_delete_swor": f"""WITH {DELETED},
a AS (SELECT {rid('v')} AS view_rid, {rid('c')} AS click_rid, row_number() OVER (ORDER BY {number(rid('v'))}, {rid('v')}, c.user_id, {number(rid('c'))}, {rid('c')}) - 1 AS j FROM vw v JOIN cl c ON abs(v.user_id - c.user_id) <= 1),
n AS (SELECT count(*) AS n FROM a), {swor_draws(50)} SELECT draw, view_rid, click_rid FROM draws JOIN a USING (j)""",
        "report_rows": """WITH top AS (SELECT max(event_id) AS t FROM events WHERE event_type IN ('view', 'click')),
m AS (SELECT CAST(i - 1 AS INTEGER) AS epoch, (t * i) // 4 + 1 AS upto, CASE WHEN i = 1 THEN -1 ELSE (t * (i - 1)) // 4 + 1 END AS since FROM top, range(1, 5) r(i)),
r AS (SELECT greatest(v.event_id, c.event_id) AS e FROM events v JOIN events c ON v.event_type = 'view' AND c.event_type = 'click' AND abs(v.user_id - c.user_id) <= 1)
SELECT epoch, CAST((SELECT count(*) FROM r WHERE e < upto AND e >= since) AS BIGINT) AS n_proc, CAST((SELECT count(*) FROM r WHERE e < upto) AS BIGINT) AS n_seen,
  CAST(least(100, (SELECT count(*) FROM r WHERE e < upto)) AS BIGINT) AS ssize,
  CAST((SELECT count(*) FROM events WHERE event_type IN ('view', 'click') AND event_id < upto AND event_id >= since) AS BIGINT) AS ntup FROM m""",
        "added_count_qy": f"SELECT CAST(count(*) AS BIGINT) AS n_added FROM {QY_FROM} WHERE l.l_linenumber > 3 OR c2.c_custkey % 5 = 0",
        "key_problems_qx": """SELECT 'missing' AS problem, 'la' AS stream, CAST(count(DISTINCT l_partkey) AS BIGINT) AS n_keys FROM lineitem
WHERE l_returnflag = 'A' AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size = 12) HAVING count(*) > 0""",
        "resolve_samples": f"""WITH a AS (
  SELECT l_quantity, o_orderpriority, c1.c_name AS n1, c2.c_name AS n2, c1.c_nationkey AS k1, c2.c_nationkey AS k2,
    row_number() OVER (ORDER BY {number(LINE_SQL.format('l'))}, {LINE_SQL.format('l')}, {number('CAST(c2.c_custkey AS VARCHAR)')}, CAST(c2.c_custkey AS VARCHAR)) - 1 AS j FROM {QY_FROM}),
n AS (SELECT count(*) AS n FROM a), {swor_draws(100)}
SELECT draw, l_quantity AS l_l_quantity, o_orderpriority AS o_o_orderpriority, n1 AS c1_c_name, n2 AS c2_c_name, k1 AS c1_c_nationkey, k2 AS c2_c_nationkey FROM draws JOIN a USING (j)""",
        "report_rows_deletes": f"""WITH top AS (SELECT max(event_id) AS t FROM events WHERE event_type IN ('view', 'click')),
m AS (SELECT CAST(i - 1 AS INTEGER) AS epoch, (t * i) // 4 + 1 AS upto, CASE WHEN i = 1 THEN -1 ELSE (t * (i - 1)) // 4 + 1 END AS since FROM top, range(1, 5) r(i)),
o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k, CASE event_type WHEN 'view' THEN 300 ELSE 100 END AS every, CASE event_type WHEN 'view' THEN 60 ELSE 20 END AS n FROM events WHERE event_type IN ('view', 'click')),
e AS (SELECT o.*, coalesce(x.event_id, {1 << 60}) AS dies FROM o LEFT JOIN o x ON x.event_type = o.event_type AND x.k = o.every * ((o.k + o.n - 1) // o.n)),
r AS (SELECT greatest(v.event_id, c.event_id) AS e, least(v.dies, c.dies) AS d FROM e v JOIN e c ON v.event_type = 'view' AND c.event_type = 'click' AND abs(v.user_id - c.user_id) <= 1)
SELECT epoch, CAST((SELECT count(*) FROM r WHERE e < upto AND e >= since AND e <= d) AS BIGINT) AS n_proc, CAST((SELECT count(*) FROM r WHERE e < upto AND d >= upto AND e <= d) AS BIGINT) AS n_seen,
  CAST(least(100, (SELECT count(*) FROM r WHERE e < upto AND d >= upto AND e <= d)) AS BIGINT) AS ssize,
  CAST((SELECT count(*) + coalesce(sum(n) FILTER (WHERE k % every = 0), 0) FROM o WHERE event_id < upto AND event_id >= since) AS BIGINT) AS ntup FROM m""",
        "report_rows_sliding": f"""WITH {EVENTS}, o AS (SELECT * FROM ev WHERE event_type IN ('view', 'click')), top AS (SELECT max(ts) AS t FROM o),
m AS (SELECT CAST(i - 1 AS INTEGER) AS epoch, (t * i) // 4 + 1 AS upto, CASE WHEN i = 1 THEN -1 ELSE (t * (i - 1)) // 4 + 1 END AS since FROM top, range(1, 5) r(i)),
w AS (SELECT *, coalesce((SELECT max(ts) FROM o WHERE ts < upto), 0) AS high FROM m),
r AS (SELECT greatest(v.ts, c.ts) AS hi, least(v.ts, c.ts) AS lo FROM o v JOIN o c ON v.event_type = 'view' AND c.event_type = 'click' AND abs(v.user_id - c.user_id) <= 1 AND abs(v.ts - c.ts) <= 43199)
SELECT epoch, CAST((SELECT count(*) FROM r WHERE hi < upto AND hi >= since) AS BIGINT) AS n_proc, high - 43199 AS win_lo, high AS win_hi,
  CAST((SELECT count(*) FROM r WHERE hi <= high AND lo >= high - 43199) AS BIGINT) AS n_seen, CAST(least(100, (SELECT count(*) FROM r WHERE hi <= high AND lo >= high - 43199)) AS BIGINT) AS ssize,
  CAST((SELECT count(*) FROM o WHERE ts < upto AND ts >= since) AS BIGINT) AS ntup FROM w""",
        "parsed_orders": "SELECT o_orderkey AS line_no, o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS o_orderdate, left(o_orderpriority, 8) AS o_orderpriority FROM orders",
        "lines_after": interleaved_sql(
            [(2, "nation", "concat(n_nationkey, ',\"', n_name, '\"')")],
            [
                (1, "orders", "concat(o_orderkey, ',', o_custkey)"),
                (0, "lineitem JOIN orders ON l_orderkey = o_orderkey", "concat(l_orderkey, ',', l_linenumber, ',', l_partkey, ',', l_suppkey, ',\"', l_returnflag, '\"') AS csv, concat(o_orderkey, ',', o_custkey) AS pcsv, '1' AS psid"),
            ], 7, converters.REPORT_EVERY, {},
        ),
        "lines_deletes": interleaved_sql(
            [(2, "nation", "concat(n_nationkey, ',\"', n_name, '\"')"), (3, "nation", "concat(n_nationkey, ',\"', n_name, '\"')")],
            [(1, "customer", "concat(c_custkey, ',', c_nationkey)"), (0, "lineitem", "concat(l_orderkey, ',', l_linenumber, ',', l_partkey, ',', l_suppkey)")], 7, 10_000, converters.QY_DELETES,
        ),
        "road_lines": f"""WITH {EVENTS}, o AS (
  SELECT event_id, ts // 3600 AS h, (CASE event_type WHEN 'view' THEN 0 ELSE 1 END) || '|0,' || ts // 3600 || ',' || user_id AS value, ts // 3600 // 24 AS day
  FROM ev WHERE event_type IN ('view', 'click') AND user_id % 2 = 0),
p AS (SELECT *, greatest(0, coalesce(max(day) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS prior FROM o)
SELECT event_id * 2 + 1 AS line_no, value FROM p UNION ALL SELECT event_id * 2, '-' FROM p WHERE day > prior UNION ALL SELECT coalesce(max(event_id) * 2 + 2, 0), '-' FROM p""",
        "edgar_rows": f"WITH {EVENTS}, {EDGAR_ROWS} SELECT line_no, sid, ts, original_ts, ip, ip24 FROM er",
        "edgar_count": f"WITH {EVENTS}, {EDGAR_ROWS} SELECT a.ts // 3600 AS \"window\", CAST(count(*) AS BIGINT) AS n_seen FROM er a JOIN er b ON a.sid = 0 AND b.sid = 1 AND a.ip24 = b.ip24 AND a.ts // 3600 = b.ts // 3600 JOIN er c ON c.sid = 2 AND b.ip24 = c.ip24 AND b.ts // 3600 = c.ts // 3600 GROUP BY 1",
        "cumulative_n_proc": f"WITH {EVENTS} SELECT CAST(count(*) AS BIGINT) AS n_proc FROM {LANES} WHERE v.event_type = 'view' AND greatest(v.ts, c.ts, p.ts) - least(v.ts, c.ts, p.ts) <= 43199",
    }
