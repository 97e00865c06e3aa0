"""Plan shape of every registered query."""
import pytest

from listingflow import plans
from listingflow.registry import QUERIES

plans.load()

SF = "/root/testdata/sf0.001"
# Streams run while they are built; their plans are plain reads of the result.
STATIC = sorted(n for n in QUERIES if not n.startswith("stream_"))


@pytest.mark.parametrize("name", STATIC)
def test_no_cross_join_and_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, bad
