"""Plan guards: no registered query plans a cartesian product or a nested-loop
join (every join is an equi-join; small fixed lists are exploded literals)."""

import pytest

from conftest import SF001

import __spark_entry__ as E

# these run jobs while they are built (iterative clustering, streaming sinks)
_EXECUTING = ("C02", "A06", "A07", "A08", "ST0")
NAMES = sorted(n for n in E.queries() if not n.startswith(_EXECUTING))


@pytest.mark.parametrize("name", NAMES)
def test_no_cartesian_or_nested_loop_join(spark, name):
    df = E.queries()[name](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
