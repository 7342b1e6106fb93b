"""Plan-shape guards over every registered query: no pair-forming joins,
no row-at-a-time Python UDFs, filters reach the scan of the flagship."""

import contextlib
import io
import os

import pytest

import __spark_entry__ as E
from tidewater import session

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@contextlib.contextmanager
def _stages():
    """Plans of the stages that are written while the block runs: what a returned frame no longer shows."""
    plans: list[str] = []
    session.stage_observers.append(lambda name, df: plans.append(f"== {name}\n{_plan(df)}"))
    try:
        yield plans
    finally:
        session.stage_observers.pop()


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_no_pair_joins_or_row_udfs(spark):
    bad = {}
    for name, fn in sorted(E.queries().items()):
        with _stages() as plans:
            plans.append(_plan(fn(spark, SF)))
        hits = [f for f in FORBIDDEN if any(f in p for p in plans)]
        if hits:
            bad[name] = hits
    assert bad == {}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_flagship_pushdown(spark):
    """Filters reach the scans; the rows are shuffled once by range and once by (key, partition)."""
    with _stages() as plans:
        last = _plan(E.queries()["pit_join"](spark, SF))
    assert len(plans) == 1 and "EqualTo(event_type,purchase)" in plans[0] and "EqualTo(event_type,view)" in plans[0]
    assert "rangepartitioning(user_id" in plans[0] and "hashpartitioning(user_id" in last


def test_spread_is_the_callers_choice(spark):
    from tidewater.operators.common import spread
    df = spark.range(0, 10, numPartitions=1)
    assert spread(df) is df
    assert spread(df, 4).rdd.getNumPartitions() == 4


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_lake_reads_are_pruned(spark):
    """Days known beforehand are a filter on the folders; days from a table become one when the query runs."""
    fixed = _plan(E.queries()["src_lake_pruned"](spark, SF))
    assert "PartitionFilters: [day#" in fixed.replace("isnotnull(", "") or "day#" in fixed.split("PartitionFilters")[1][:120]
    found = E.queries()["src_lake_days"](spark, SF)
    assert "dynamicpruning" in _plan(found)
    found.collect()
    scans = [n for n in _nodes(found) if "FileSourceScan" in n.getClass().getSimpleName() and "PartitionFilters" in n.toString() and "dynamicpruning" in n.toString()]
    read = scans[0].metrics().get("numPartitions").get().value()
    base = spark.read.json(scans[0].relation().location().rootPaths().head().toString())
    assert 0 < read < base.select("year", "month", "day").distinct().count()


def _nodes(df):
    """Nodes of the executed plan, query stages opened."""
    todo, out = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        n = todo.pop()
        out.append(n)
        name = n.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(n.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(n.plan())
        else:
            c = n.children()
            todo += [c.apply(i) for i in range(c.size())]
    return out
