"""The registered join queries on the smallest tables, against SQL that makes the joins in full."""

from __future__ import annotations

import os

import pytest

import __spark_entry__
from tests.compare import database, differences
from tributary import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the generated tables are not here")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_sql(spark, name):
    assert differences(spark, database(SF), name, queries.queries()[name], queries.oracle_sql()[name], SF) == ""


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 100
    assert set(queries.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_counts_plan_no_python(spark):
    for name in ("count_qx", "count_qy", "count_qz", "tumbling_count"):
        plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_bottom_k_draws_any_line(spark):
    drawn = queries.queries()["bottomk_swor_qx"](spark, SF).collect()
    lines = {r[c].split("|")[1] for r in drawn for c in ("lr_rid", "la_rid")}
    assert len(drawn) == 100 and lines > {"1", "2", "3"}


def test_reports_make_no_results(spark, monkeypatch):
    """Neither deletes nor windows make reports enumerate the join."""
    from tributary.operators import enumerate as enumeration

    monkeypatch.setattr(enumeration, "results", None)
    for name in ("report_rows", "report_rows_deletes", "report_rows_sliding"):
        assert queries.queries()[name](spark, SF).count() == 4
