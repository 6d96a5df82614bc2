"""Print plan facts for every registered query: cartesian / nested-loop joins,
exchanges, window group limits, python UDF nodes, scan ReadSchemas."""
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from botqa.plans import QUERIES, run_query  # noqa: E402
from botqa.session import get_session  # noqa: E402

SKIP = {"C02", "A06", "A07", "A08", "ST0"}  # these execute jobs while planning


def main():
    spark = get_session("local[4]", 8)
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    for name in QUERIES:
        if any(name.startswith(s) for s in SKIP) or (pats and not any(p in name for p in pats)):
            continue
        df = run_query(spark, sf, name)
        plan = df._jdf.queryExecution().executedPlan().toString()
        facts = {
            "cartesian": plan.count("CartesianProduct"),
            "nlj": plan.count("BroadcastNestedLoopJoin"),
            "exch": plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning"),
            "wgl": plan.count("WindowGroupLimit"),
            "pyudf": len(re.findall(r"(ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas)", plan)),
        }
        flag = " <-- check" if facts["cartesian"] or facts["nlj"] else ""
        print(f"{name:40s} {facts}{flag}")
    spark.stop()


if __name__ == "__main__":
    main()
