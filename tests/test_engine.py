"""Counts, numbering, samples, windows and deletes on small tables, against plain enumeration."""

from __future__ import annotations

import random
from collections import Counter
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tributary.operators import reports, sampling
from tributary.operators.bandjoin import band_join
from tributary.operators.tables import arrival, running
from tributary.plans.planner import fold, plan
from tributary.plans.spec import QueryError, SampleSpec
from tributary.query import JoinQuery


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(3)
    fact = [(i, r.randrange(6), r.randrange(4), r.randrange(40)) for i in range(60)]
    dim = [(k, k % 3) for k in range(6)]
    side = [(i, r.randrange(3), r.randrange(40)) for i in range(25)]
    tail = [(i, r.randrange(40)) for i in range(20)]
    return fact, dim, side, tail


def query(spark, tables, algorithm="folded", width=2):
    fact, dim, side, tail = tables
    q = JoinQuery(algorithm)
    q.add_stream("f", frame(spark, fact, "id long, d long, g long, x long"), "id").add_stream("d", frame(spark, dim, "k long, c long"), "k", primary_key="k")
    q.add_stream("s", frame(spark, side, "id long, c long, y long"), "id").add_stream("t", frame(spark, tail, "id long, z long"), "id")
    q.add_equi_join("f", "d", "d", "k", foreign_key="f").add_equi_join("d", "c", "s", "c")
    return q.add_band_join("s", "y", "t", "z", width)


def brute(tables, width=2):
    fact, dim, side, tail = tables
    return [
        (str(f[0]), str(d[0]), str(s[0]), str(t[0]))
        for f, d, s, t in product(fact, dim, side, tail)
        if f[1] == d[0] and d[1] == s[1] and abs(s[2] - t[1]) <= width
    ]


@pytest.mark.parametrize("algorithm", ["folded", "plain", "enumerate"])
@pytest.mark.parametrize("width", [0, 2])
def test_counts(spark, tables, algorithm, width):
    assert query(spark, tables, algorithm, width).num_seen() == len(brute(tables, width))


def test_results(spark, tables):
    rows = query(spark, tables).results().collect()
    assert sorted(tuple(r) for r in rows) == sorted(brute(tables))


def test_row_weights(spark, tables):
    rows = query(spark, tables).row_weights().collect()
    assert {r["rid"]: r["weight"] for r in rows} == Counter(x[0] for x in brute(tables))


@pytest.mark.parametrize("algorithm", ["folded", "plain"])
def test_numbers_name_each_result_once(spark, tables, algorithm):
    q = query(spark, tables, algorithm)
    n = len(brute(tables))
    rows = q.by_numbers(list(range(n))).collect()
    assert sorted(r["draw"] for r in rows) == list(range(n))
    assert sorted((r["f_rid"], r["d_rid"], r["s_rid"], r["t_rid"]) for r in rows) == sorted(brute(tables))


def test_dangling_references_and_trust(spark):
    f = frame(spark, [(1, 1), (2, 9), (3, None)], "id long, k long")
    d = frame(spark, [(1,)], "k long")
    s = frame(spark, [(1, 1), (2, 2)], "id long, g long")
    q = JoinQuery().add_stream("f", f, "id").add_stream("d", d, "k", primary_key="k").add_stream("s", s, "id")
    q.add_equi_join("f", "k", "d", "k", foreign_key="f").add_equi_join("f", "id", "s", "id")
    assert q.num_seen() == 1
    assert q.count_frame(trust_keys=True).first()["n_seen"] == 2  # rows 1 and 2 have partners


def test_single_group_query(spark, tables):
    fact, dim, _, _ = tables
    q = JoinQuery().add_stream("f", frame(spark, fact, "id long, d long, g long, x long"), "id").add_stream("d", frame(spark, dim, "k long, c long"), "k", primary_key="k")
    q.add_equi_join("f", "d", "d", "k", foreign_key="f")
    assert q.num_seen() == len(fact)
    assert len(q.set_sampling_without_replacement(10).samples().collect()) == 10


def test_filters(spark, tables):
    fact = tables[0]
    base = lambda: JoinQuery().add_stream("f", frame(spark, fact, "id long, d long, g long, x long"), "id")
    assert base().add_equi_filter("f", "g", 2).num_seen() == sum(r[2] == 2 for r in fact)
    assert base().add_neq_filter("f", "g", 2).num_seen() == sum(r[2] != 2 for r in fact)
    assert base().add_band_filter("f", "x", 20, 5).num_seen() == sum(15 <= r[3] <= 25 for r in fact)


def test_conflicting_foreign_keys_fall_back(spark):
    a, b = frame(spark, [(1, 1)], "id long, k long"), frame(spark, [(1, 1), (2, 1)], "id long, k long")
    d = frame(spark, [(1,)], "k long")
    q = JoinQuery().add_stream("a", a, "id").add_stream("b", b, "id").add_stream("d", d, "k", primary_key="k")
    q.add_equi_join("a", "k", "d", "k", foreign_key="a").add_equi_join("b", "k", "d", "k", foreign_key="b")
    groups = fold(q.spec)
    assert groups["d"] is groups["a"] and groups["b"] is not groups["a"]
    assert q.num_seen() == 2


def test_rejected_queries(spark):
    t = frame(spark, [(1, 2, "x")], "id long, v long, s string")
    two = lambda: JoinQuery().add_stream("a", t, "id").add_stream("b", t, "id")
    with pytest.raises(QueryError, match="not joined"):
        plan(two().spec)
    with pytest.raises(QueryError, match="cycle"):
        plan(two().add_equi_join("a", "id", "b", "id").add_equi_join("a", "v", "b", "v").spec)
    with pytest.raises(QueryError, match="type"):
        plan(two().add_equi_join("a", "id", "b", "s").spec)
    with pytest.raises(QueryError, match="whole-number"):
        plan(two().add_band_join("a", "s", "b", "s", 1).spec)
    with pytest.raises(QueryError, match="time column"):
        plan(two().add_equi_join("a", "id", "b", "id").set_tumbling_window(5).spec)
    with pytest.raises(QueryError, match="no primary key"):
        plan(two().add_equi_join("a", "id", "b", "id", foreign_key="a").spec)
    with pytest.raises(QueryError):
        two().set_bernoulli_sampling(1.0)
    with pytest.raises(QueryError):
        two().set_sampling_with_replacement(0)


def test_weights_beyond_a_long(spark):
    """Ten tables of 100 equal keys: 10**20 results, which only weights and numbers can handle."""
    t = frame(spark, [(i, 1) for i in range(100)], "id long, k long")
    q = JoinQuery()
    for i in range(10):
        q.add_stream(f"t{i}", t, "id")
        if i:
            q.add_equi_join("t0", "k", f"t{i}", "k")
    assert q.num_seen() == 10**20
    row = q.by_numbers([10**20 - 1]).collect()
    assert len(row) == 1


def test_nulls_and_empty_tables(spark):
    a, b = frame(spark, [(1, None), (2, 5)], "id long, k long"), frame(spark, [(1, None), (2, 5)], "id long, k long")
    q = JoinQuery().add_stream("a", a, "id").add_stream("b", b, "id").add_equi_join("a", "k", "b", "k")
    assert q.num_seen() == 1
    empty = frame(spark, [], "id long, k long")
    q = JoinQuery().add_stream("a", a, "id").add_stream("b", empty, "id").add_equi_join("a", "k", "b", "k").set_sampling_without_replacement(3)
    assert q.num_seen() == 0 and q.samples().count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 400), st.integers(1, 50), st.booleans())
def test_drawn_numbers(size, k, fixed):
    for kind in ("swor", "swr"):
        got = sampling.draw_numbers(SampleSpec(kind, k, 5, fixed), size)
        assert all(0 <= j < size for j in got)
        assert len(got) == (min(k, size) if kind == "swor" else k if size else 0)
        assert kind == "swr" or len(set(got)) == len(got)


def test_samples_are_uniform():
    """Chi-square of how often each of 20 results is drawn, over many seeds."""
    for kind, k in (("swor", 5), ("swr", 5)):
        hits = Counter()
        for seed in range(4000):
            hits.update(sampling.draw_numbers(SampleSpec(kind, k, seed), 20))
        want = 4000 * k / 20
        assert sum((hits[j] - want) ** 2 / want for j in range(20)) < 45  # 99.9 % of 19 degrees: 43.8


def test_bernoulli_numbers(spark):
    got = [int(r["_j"]) for r in sampling.bernoulli_numbers(spark, SampleSpec("bernoulli", 0.01, 9), 1_000_000, each=1000).collect()]
    assert len(set(got)) == len(got) and 0 <= min(got) and max(got) < 1_000_000
    assert abs(len(got) - 10_000) < 500
    again = [int(r["_j"]) for r in sampling.bernoulli_numbers(spark, SampleSpec("bernoulli", 0.01, 9), 1_000_000, each=1000).collect()]
    assert sorted(got) == sorted(again)


@pytest.mark.parametrize("algorithm", ["folded", "enumerate"])
@pytest.mark.parametrize("kind", ["swor", "swr", "bernoulli"])
def test_samples_are_results(spark, tables, algorithm, kind):
    q = query(spark, tables, algorithm)
    q = q.set_bernoulli_sampling(0.2) if kind == "bernoulli" else getattr(q, {"swor": "set_sampling_without_replacement", "swr": "set_sampling_with_replacement"}[kind])(30)
    rows = [tuple(r[c] for c in ("f_rid", "d_rid", "s_rid", "t_rid")) for r in q.samples().collect()]
    results = set(brute(tables))
    assert set(rows) <= results
    if kind == "swor":
        assert len(rows) == len(set(rows)) == min(30, len(results))
    if kind == "swr":
        assert len(rows) == 30


def test_repairs(spark, tables):
    for kind in ("swor", "swr", "bernoulli"):
        q = query(spark, tables)
        q = q.set_bernoulli_sampling(0.3) if kind == "bernoulli" else getattr(q, {"swor": "set_sampling_without_replacement", "swr": "set_sampling_with_replacement"}[kind])(40)
        sample = q.samples().cache()
        after = q.after_deletes({"f": "id", "s": "id"}, {"f": 20, "s": 5})
        after.spec.sampling = q.spec.sampling
        left = {x for x in brute(tables) if int(x[0]) >= 20 and int(x[2]) >= 5}
        got = [tuple(r[c] for c in ("f_rid", "d_rid", "s_rid", "t_rid")) for r in after.repaired(sample).collect()]
        assert set(got) <= left
        assert after.num_seen() == len(left)
        old = {tuple(r[c] for c in ("f_rid", "d_rid", "s_rid", "t_rid")) for r in sample.collect()}
        assert old & left <= set(got)
        if kind == "swor":
            assert len(set(got)) == len(got) == min(40, len(left))
        if kind == "swr":
            assert len(got) == 40


def test_delete_of_more_than_there_is(spark, tables):
    q = query(spark, tables).after_deletes({"f": "id"}, {"f": 10_000})
    assert q.num_seen() == 0


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(-50, 50), max_size=30), st.lists(st.integers(-50, 50), max_size=30), st.integers(0, 8))
def test_band_join(spark, left, right, width):
    a = frame(spark, list(enumerate(left)), "i long, k long")
    b = frame(spark, list(enumerate(right)), "j long, m long")
    got = sorted((r["i"], r["j"]) for r in band_join(a, "k", b, "m", width).select("i", "j").collect())
    assert got == sorted((i, j) for i, x in enumerate(left) for j, y in enumerate(right) if abs(x - y) <= width)


def replay(rows, size, kind, d):
    """Row by row: live results and results ever made, in a window over time-ordered rows (sid, id, ts, k)."""
    held, made, live, low = {0: [], 1: []}, 0, 0, None
    for sid, i, ts, k in rows:
        if kind == "sliding":
            low = ts - size + 1
        elif kind == "tumbling":
            low = ts // size * size
        if low is not None:
            held = {s: [r for r in own if r[1] >= low] for s, own in held.items()}
        made += sum(abs(r[2] - k) <= d for r in held[1 - sid])
        held[sid].append((i, ts, k))
        live = sum(abs(a[2] - b[2]) <= d for a in held[0] for b in held[1])
    return live, made


@pytest.mark.parametrize("kind", ["none", "tumbling", "sliding"])
def test_windows_like_a_replay(spark, kind):
    r = random.Random(8)
    rows, ts = [], 0
    for i in range(80):
        ts += r.randrange(4)
        rows.append((r.randrange(2), i, ts, r.randrange(10)))
    live, made = replay(rows, 25, kind, 1)
    q = JoinQuery()
    for sid in (0, 1):
        q.add_stream(f"s{sid}", frame(spark, [x[1:] for x in rows if x[0] == sid], "id long, ts long, k long"), "id", ts="ts")
    q.add_band_join("s0", "k", "s1", "k", 1)
    if kind != "none":
        getattr(q, f"set_{kind}_window")(25)
    assert q.num_seen() == live
    assert q.results().count() == made


def test_running_and_arrival(spark):
    r = random.Random(1)
    rows = [(i * 7, r.randrange(3), r.randrange(-5, 9)) for i in range(500)]
    df = frame(spark, rows, "o long, g int, v long").repartition(5)
    got = {x["o"]: x for x in running(running(running(df, "o", F.col("v"), "s", step=100), "o", F.col("v"), "lo", "min", 100), "o", F.col("v"), "hi", "max", 100).collect()}
    total, low, high = 0, 99, -99
    for o, _, v in rows:
        total, low, high = total + v, min(low, v), max(high, v)
        assert (got[o]["s"], got[o]["lo"], got[o]["hi"]) == (total, low, high)
    seen = Counter()
    for x in sorted(arrival(df, ["g"], "o", 64).collect(), key=lambda x: x["o"]):
        assert x["_idx"] == seen[x["g"]]
        seen[x["g"]] += 1


def test_lifetimes(spark):
    """Deletes pop the oldest stored rows; one that asks for more takes all there are, and later rows stay."""
    r = random.Random(4)
    log, stored, dies, k = [], [], {}, 0
    for line in range(300):
        if r.random() < 0.12:
            n = r.randrange(0, 14)
            log.append((line, "d", n))
            for x in stored[:n]:
                dies[x] = line
            stored = stored[n:]
        else:
            log.append((line, "i", None))
            stored.append(line)
    rows = frame(spark, [(x,) for x, kind, _ in log if kind == "i"], "line_no long")
    deletes = frame(spark, [(x, n) for x, kind, n in log if kind == "d"], "line_no long, n long")
    got = {x["line_no"]: x["_dies"] for x in reports.lifetimes(rows, deletes).collect()}
    assert got == {x: dies.get(x) for x, kind, _ in log if kind == "i"}
    none = reports.lifetimes(rows, deletes.limit(0)).collect()
    assert {x["_dies"] for x in none} == {None}


def test_estimates(spark, tables):
    q = query(spark, tables).set_sampling_without_replacement(10_000)
    drawn = q.resolve(q.samples(), {"f": ["x"]})
    got = q.estimate(drawn, "f_x").first()
    xs = {str(f[0]): f[3] for f in tables[0]}
    assert got["n_seen"] == len(brute(tables))
    assert abs(got["estimated_sum"] - sum(xs[b[0]] for b in brute(tables))) < 1e-6


def test_names_tell_rows_apart(spark):
    """Bars, backslashes, nulls and parts of seconds don't make two rows' names equal; rows that are equal are drawn once each."""
    import datetime

    at = datetime.datetime(2024, 1, 1, 0, 0, 0)
    rows = [("a|b", "c", at, 1), ("a", "b|c", at, 1), (None, "x", at, 1), ("\\N", "x", at, 1), ("\\", "N|x", at, 1), ("a", "b", at, 1), ("a", "b", at.replace(microsecond=100_000), 1), ("", "x", at, 1)]
    t = frame(spark, rows + rows[:1], "a string, b string, t timestamp_ntz, k int")
    q = JoinQuery().add_stream("t", t, ("a", "b", "t")).add_stream("u", frame(spark, [(1, 1)], "id int, k int"), "id").add_equi_join("t", "k", "u", "k")
    drawn = q.set_sampling_without_replacement(20).samples({"t": ["b"]}).collect()
    assert len(drawn) == 9 and len({r["t_rid"] for r in drawn}) == 8 and len({r["draw"] for r in drawn}) == 9
    assert q.set_sampling_without_replacement(2, deterministic=True).samples().count() == 2
    assert q.resolve(q.samples(), {"t": ["b"]}).count() == 2


def test_windows_of_large_times(spark):
    """Two times, one nanosecond apart, in different windows of a second."""
    a, b = frame(spark, [(1, 1_699_999_999_999_999_999, 1)], "id long, ts long, k long"), frame(spark, [(1, 1_700_000_000_000_000_000, 1)], "id long, ts long, k long")
    q = JoinQuery().add_stream("a", a, "id", ts="ts").add_stream("b", b, "id", ts="ts").add_equi_join("a", "k", "b", "k").set_tumbling_window(10**9)
    assert q.count_frame().count() == 0


@pytest.mark.parametrize("width", [1, 3, 50])
def test_band_sums(spark, width):
    from tributary.operators.bandjoin import band_sums

    r = random.Random(width)
    keys = {(r.randrange(-60, 60), r.randrange(2)) for _ in range(60)}
    told = {(r.randrange(-60, 60), r.randrange(2)): r.randrange(1, 9) for _ in range(60)}
    one = frame(spark, list(keys), "k int, w int")
    two = frame(spark, [(k, w, m) for (k, w), m in told.items()], "t int, w2 int, m long").selectExpr("t", "w2", "CAST(m AS decimal(38,0)) AS _m")
    got = {(x["k"], x["w"]): int(x["_m"]) for x in band_sums(one, "k", two, "t", width, [("w", "w2")]).collect()}
    want = {(k, w): sum(m for (t, v), m in told.items() if v == w and abs(t - k) <= width) for k, w in keys}
    assert got == {k: m for k, m in want.items() if m}
    plan_text = band_sums(one, "k", two, "t", width)._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan_text  # no pairs of keys


def test_repairs_draw_independently(spark):
    """Two repairs over much the same rows don't draw the same numbers."""
    t = frame(spark, [(i, 1) for i in range(600)], "id long, k long")
    q = lambda low: JoinQuery().add_stream("t", t.filter(F.col("id") >= low), "id").set_sampling_with_replacement(20)
    none = spark.createDataFrame([], "draw long, t_rid string")
    one, two = ([r["t_rid"] for r in q(low).repaired(none).orderBy("draw").collect()] for low in (100, 101))
    assert len(one) == len(two) == 20 and sum(a == b or abs(int(a) - int(b)) == 1 for a, b in zip(one, two)) < 5


def test_deltas_read_old_tables_by_their_keys(spark):
    """A batch's term has the new rows at the root, and old tables only pass on rows with their keys."""
    from tributary.operators import maintain
    from tributary.operators.weights import total

    old = frame(spark, [(i, i) for i in range(5000)], "id long, k long")
    q = JoinQuery().add_stream("a", old, "id").add_stream("b", old, "id").add_equi_join("a", "k", "b", "k")
    (term,) = maintain.terms(q.spec, {"b": frame(spark, [(1, 7), (2, 8)], "id long, k long")})
    assert term.tree().group.root == "b" and term.size() == 2
    text = total(term.spec, term.tree(), near=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in text


def test_bernoulli_numbers_can_be_repeated(spark):
    how = SampleSpec("bernoulli", 0.02, 9, True)
    got = sorted(int(r["_j"]) for r in sampling.bernoulli_numbers(spark, how, 100_000, each=500).collect())
    blocks = 4
    want = []
    for b in range(blocks):
        at, i = b * 25_000 - 1, 0
        while (at := at + sampling.fixed_gap(f"9|{b}", i, 0.02)) < (b + 1) * 25_000:
            want.append(at)
            i += 1
    assert got == want and abs(len(got) - 2000) < 220


@pytest.mark.parametrize("kind", ["none", "tumbling", "sliding"])
def test_reports_like_a_replay(spark, kind):
    """A log of three streams with deletes, or windows with late rows, against a replay line by line."""
    r = random.Random(5)
    held, log, rows, want, clock, made, tuples = {0: [], 1: [], 2: []}, [], {0: [], 1: [], 2: []}, [], None, 0, 0
    size, ts = 12, 0
    match = lambda a, b, c: a[2] == b[2] and abs(b[3] - c[3]) <= 1

    def live():
        return sum(match(a, b, c) for a in held[0] for b in held[1] for c in held[2])

    def limit(t):
        return t + size if kind == "sliding" else (t // size + 1) * size

    for line in range(160):
        x = r.random()
        if x < 0.06:
            log.append((line, "report", None, None))
            want.append((made, live(), tuples))
            made = tuples = 0
        elif x < 0.16 and kind == "none":
            sid, n = r.randrange(3), r.randrange(1, 6)
            log.append((line, "delete", sid, n))
            held[sid] = held[sid][n:]
            tuples += n
        else:
            sid = r.randrange(3)
            ts += r.randrange(3)
            row = (line, ts - (r.randrange(25) if r.random() < 0.2 else 0), r.randrange(3), r.randrange(4))
            log.append((line, "insert", sid, None))
            rows[sid].append(row)
            tuples += 1
            if kind != "none":
                clock = row[1] if clock is None else max(clock, row[1])
                held = {s: [o for o in own if limit(o[1]) > clock] for s, own in held.items()}
                if limit(row[1]) <= clock:
                    continue
            before = live()
            held[sid].append(row)
            made += live() - before
    log.append((160, "report", None, None))
    want.append((made, live(), tuples))
    q = JoinQuery()
    frames = {f"s{i}": frame(spark, rows[i], "line_no long, ts long, k long, m long") for i in range(3)}
    for n, f in frames.items():
        q.add_stream(n, f, "line_no", ts="ts")
    q.add_equi_join("s0", "k", "s1", "k").add_band_join("s1", "m", "s2", "m", 1)
    if kind != "none":
        getattr(q, f"set_{kind}_window")(size)
    got = reports.report_rows(q.spec, frame(spark, log, "line_no long, kind string, sid int, n long"), frames, {i: f"s{i}" for i in range(3)}, lambda n: n)
    assert [(x["n_proc"], x["n_seen"], x["ntup"]) for x in got.orderBy("epoch").collect()] == want


@pytest.mark.parametrize("kind", ["long", "decimal(38,0)"])
def test_many_draws_meet_their_rows_alone(spark, monkeypatch, kind):
    """Very many draws go to rows by bins of numbers, not by all of a key; the same rows as those looked up one by one."""
    from tributary.operators import unrank

    r = random.Random(11)
    q = JoinQuery().add_stream("f", frame(spark, [(i, r.randrange(3), r.choice([0, 0, 0, 1])) for i in range(30)], "id long, a long, b long"), "id")
    q.add_stream("s", frame(spark, [(i, r.randrange(4), r.choice([0, 1, 1, 1, 2])) for i in range(24)], "id long, a long, y long"), "id")
    q.add_stream("t", frame(spark, [(i, r.choice([0, 1, 1, 1, 1, 5])) for i in range(12)], "id long, y long"), "id")
    q.add_stream("u", frame(spark, [(i, i % 2) for i in range(9)], "id long, b long"), "id")
    q.add_equi_join("f", "a", "s", "a").add_equi_join("s", "y", "t", "y").add_equi_join("f", "b", "u", "b").set_bernoulli_sampling(0.5, seed=4, deterministic=True)
    few = q.samples({"s": ["y"], "u": ["b"]})
    monkeypatch.setattr(unrank, "MANY", 0)
    monkeypatch.setattr(unrank, "number_type", lambda p: kind)
    many = q.samples({"s": ["y"], "u": ["b"]})
    assert many.columns == few.columns
    got, want = Counter(many.collect()), Counter(few.collect())
    assert got == want and abs(sum(got.values()) - q.num_seen() / 2) < 4 * q.num_seen() ** 0.5 / 2
    joins = [x for x in many._jdf.queryExecution().executedPlan().toString().split("\n") if "MergeJoin" in x]
    assert any("_bin" in x for x in joins) and not any("_j" in x and "_bin" not in x for x in joins)


def test_bernoulli_samples_of_large_joins_take_bins(spark):
    """Of 4 million results of one key 80,000 are drawn: no join meets each draw with all rows of the key."""
    rows = spark.range(2000).select("id", (F.col("id") * 0).alias("k"))
    q = JoinQuery().add_stream("a", rows, "id").add_stream("b", rows, "id").add_equi_join("a", "k", "b", "k").set_bernoulli_sampling(0.02, seed=5, deterministic=True)
    sample = q.samples()
    text = sample._jdf.queryExecution().executedPlan().toString()
    assert "_bin" in text and not [x for x in text.split("\n") if "Join" in x and "_j" in x and "_bin" not in x]
    got = sample.collect()
    assert abs(len(got) - 80_000) < 1200 and len({(r["a_rid"], r["b_rid"]) for r in got}) == len(got)


def test_results_of_a_hot_key_are_dealt_over_tasks(spark, monkeypatch):
    """A key with most pairs is no single task's work; copies, cold keys and nulls come out as a plain join has them."""
    from tributary.operators import enumerate as enumeration

    for name, value in {"FEW": 0, "PART": 64, "CHUNK": 16}.items():
        monkeypatch.setattr(enumeration, name, value, raising=False)
    left = [(i, 0) for i in range(600)] + [(7, 0), (7, 0), (900, 1), (901, None), (902, 5)]
    right = [(i, 0) for i in range(500)] + [(3, 0)] * 20 + [(800, 1), (801, 1), (802, None), (803, 6)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        q = JoinQuery("enumerate").add_stream("a", frame(spark, left, "id long, k int"), "id").add_stream("b", frame(spark, right, "id long, k int"), "id").add_equi_join("a", "k", "b", "k")
        made = q.results().withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert Counter((r["a_rid"], r["b_rid"]) for r in made) == Counter((str(a), str(b)) for (a, x), (b, y) in product(left, right) if x == y and x is not None)
    assert max(Counter(r["task"] for r in made).values()) < len(made) / 2


@pytest.mark.parametrize("window", [0, 50])
def test_results_of_chains_of_hot_keys(spark, monkeypatch, window):
    from tributary.operators import enumerate as enumeration

    r = random.Random(8)
    rows = [[(i, r.randrange(100), r.choice([0, 0, 0, 1, 2, None]), r.choice([0, 0, 4])) for i in range(n)] for n in (60, 50, 40)]
    q = JoinQuery("enumerate")
    for i, own in enumerate(rows):
        q.add_stream(f"s{i}", frame(spark, own, "id long, ts long, k long, m long"), "id", ts="ts")
    q.add_equi_join("s0", "k", "s1", "k").add_equi_join("s1", "m", "s2", "m")
    if window:
        q.set_tumbling_window(window)
    kept = [x for x in product(*rows) if x[0][2] == x[1][2] is not None and x[1][3] == x[2][3] and (not window or len({y[1] // window for y in x}) == 1)]
    for name, value in {"FEW": 0, "PART": 8, "TALL": 1, "CHUNK": 4}.items():
        monkeypatch.setattr(enumeration, name, value, raising=False)
    got = q.results()
    assert Counter(map(tuple, got.collect())) == Counter((*[str(y[0]) for y in x], min(y[1] for y in x), max(y[1] for y in x)) for x in kept)


def test_results_of_hot_keys_take_few_bytes(spark, monkeypatch, tmp_path):
    """Results are laid out so that Parquet's pages, each compressed by itself, need little for a row; none is lost for it."""
    from tributary.operators import enumerate as enumeration

    monkeypatch.setattr(enumeration, "FEW", 0)
    m, n = 2500, 3000
    left, right = (spark.range(rows).select((F.col("id") + 10**6).alias("id"), (F.col("id") * 0).alias("k")) for rows in (m, n))
    q = JoinQuery("enumerate").add_stream("a", left, "id").add_stream("b", right, "id").add_equi_join("a", "k", "b", "k")
    q.results().write.parquet(str(tmp_path / "out"))
    made = spark.read.parquet(str(tmp_path / "out"))
    for mine, other, rows, times in (("a_rid", "b_rid", m, n), ("b_rid", "a_rid", n, m)):
        each = made.groupBy(mine).agg(F.count("*").alias("n"), F.count_distinct(other).alias("d")).agg(F.count("*"), F.min("n"), F.max("n"), F.min("d")).first()
        assert tuple(each) == (rows, times, times, times)
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 0.2 * m * n
