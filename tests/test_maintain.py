"""Rows that arrive in batches, and foreign keys that depend on arrival."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tributary.operators import maintain
from tributary.query import JoinQuery


def chain(spark, a, b, c):
    q = JoinQuery()
    for name, rows in (("a", a), ("b", b), ("c", c)):
        q.add_stream(name, spark.createDataFrame(rows, "id long, k long, m long"), "id")
    return q.add_equi_join("a", "k", "b", "k").add_band_join("b", "m", "c", "m", 1)


def results(a, b, c):
    return {(str(x[0]), str(y[0]), str(z[0])) for x in a for y in b for z in c if x[1] == y[1] and abs(y[2] - z[2]) <= 1}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    return [[(i, r.randrange(5), r.randrange(12)) for i in range(40)] for _ in range(3)]


def test_added_results(spark, rows):
    old, new = [x[:25] for x in rows], [x[25:] for x in rows]
    q = chain(spark, *old)
    frames = {n: spark.createDataFrame(x, "id long, k long, m long") for n, x in zip("abc", new)}
    both, before = results(*rows), results(*old)
    assert q.added(frames) == len(both) - len(before)
    assert q.added({"b": frames["b"]}) == len(results(old[0], rows[1], old[2]) - before)
    assert q.grown(frames).num_seen() == len(both)
    parts = maintain.added(q.spec, frames)
    n = sum(x for _, x in parts)
    got = maintain.by_numbers(parts, [(i, i) for i in range(n)]).collect()
    assert {(r["a_rid"], r["b_rid"], r["c_rid"]) for r in got} == both - before and len(got) == n


@pytest.mark.parametrize("kind", ["swor", "swr", "bernoulli"])
def test_absorbed_samples(spark, rows, kind):
    old, new = [x[:25] for x in rows], [x[25:] for x in rows]
    q = chain(spark, *old)
    {"swor": lambda: q.set_sampling_without_replacement(30), "swr": lambda: q.set_sampling_with_replacement(30), "bernoulli": lambda: q.set_bernoulli_sampling(0.2)}[kind]()
    frames = {n: spark.createDataFrame(x, "id long, k long, m long") for n, x in zip("abc", new)}
    sample = q.samples().cache()
    out = q.absorbed(sample, frames).collect()
    got = [(r["a_rid"], r["b_rid"], r["c_rid"]) for r in out]
    assert set(got) <= results(*rows)
    assert any(x not in results(*old) for x in got)
    if kind != "bernoulli":
        assert len(got) == 30
    if kind == "swor":
        assert len(set(got)) == 30
    empty = q.absorbed(sample, {"a": frames["a"].limit(0)}).collect()
    assert Counter(tuple(r) for r in empty) == Counter(tuple(r) for r in sample.select(*empty[0].__fields__).collect())


def test_first_sample_from_nothing(spark, rows):
    q = chain(spark, [], [], []).set_sampling_without_replacement(7)
    frames = {n: spark.createDataFrame(x, "id long, k long, m long") for n, x in zip("abc", rows)}
    assert q.absorbed(q.samples(), frames).count() == 7


def keyed(spark):
    facts = [(1, 10, 1), (2, 20, 1), (3, 30, 2), (4, 40, 9)]  # id, line, key
    dims = [(1, 15, 7), (1, 5, 8), (2, 50, 7)]  # key, line, colour
    other = [(1, 0, 7), (2, 0, 8), (3, 0, 8)]  # id, line, colour
    q = JoinQuery().add_stream("f", spark.createDataFrame(facts, "id long, line long, k long"), "id")
    q.add_stream("d", spark.createDataFrame(dims, "k long, line long, c long"), ("k", "line"), primary_key="k").add_stream("o", spark.createDataFrame(other, "id long, line long, c long"), "id")
    return q.add_equi_join("f", "k", "d", "k", foreign_key="f").add_equi_join("d", "c", "o", "c")


def test_key_semantics(spark):
    assert keyed(spark).num_seen() == 2 * (1 + 2) + 1  # relational: each row of a key counts
    assert keyed(spark).set_key_semantics(order="line").num_seen() == 2 * 2  # colour 8 was first; key 2 came too late
    assert keyed(spark).set_key_semantics(first_wins=True).num_seen() == keyed(spark).set_key_semantics(first_wins=True).num_seen()
    problems = {(r["problem"], r["stream"], r["key"]) for r in keyed(spark).key_problems().collect()}
    assert problems == {("duplicate", "d", "1"), ("missing", "f", "9")}
    assert keyed(spark).key_problems().select(F.col("key")).count() == 2
