"""Where a hot series would meet one task: plans of all that a query writes and returns.

    python tools/plans.py [--sf DIR] [name …]
"""

from __future__ import annotations

import argparse
import re
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql.readwriter import DataFrameWriter  # noqa: E402

#: What series are known by in the registered queries.
SERIES = r"(?:series_id|user_id|event_type)"
SETTINGS = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}


@contextmanager
def plain_plans(spark: SparkSession) -> Iterator[None]:
    """Joins are shuffled and plans are as they would run."""
    before = {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@contextmanager
def written(into: list) -> Iterator[None]:
    """Collect the plan of every table written to parquet."""
    plain = DataFrameWriter.parquet

    def noted(self, *args, **kwargs):
        into.append(self._df._jdf.queryExecution().executedPlan())
        return plain(self, *args, **kwargs)

    DataFrameWriter.parquet = noted
    try:
        yield
    finally:
        DataFrameWriter.parquet = plain


def _children(node) -> list:
    found = node.children()
    return [found.apply(i) for i in range(found.size())]


def gathered(node) -> list[str]:
    """Final aggregates and windows that stand on a join by series with no exchange between."""
    out = []
    name, text = node.nodeName(), node.simpleString(400)
    needs = name.startswith("Window") or ("Aggregate" in name and not re.search(r"functions=\[(?:partial_|\])", text))
    if needs:
        below = _children(node)
        while below:
            n = below.pop()
            if "Exchange" in n.nodeName():
                continue
            if re.match("SortMergeJoin|ShuffledHashJoin", n.nodeName()):
                if re.match(rf"\w+ \[{SERIES}#\d+L?\], ", n.simpleString(400)):
                    out.append(f"{text[:120]} above {n.simpleString(120)}")
                continue
            below += _children(n)
    return out + [x for child in _children(node) for x in gathered(child)]


def hot_spots(spark: SparkSession, build: Callable[[], DataFrame]) -> list[str]:
    """``gathered`` over every plan that ``build`` runs, and over its result's."""
    plans: list = []
    with plain_plans(spark), written(plans):
        result = build()
        plans.append(result._jdf.queryExecution().executedPlan())
        return [x for plan in plans for x in gathered(plan)]


def main() -> int:
    from compare import session

    from tideloom.plans import QUERIES

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.001")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark, found = session(), 0
    for name in args.names or sorted(QUERIES):
        spots = hot_spots(spark, lambda: QUERIES[name](spark, args.sf))
        found += bool(spots)
        if spots:
            print(name, *spots, sep="\n   ")
    print("queries with hot spots:", found)
    return found


if __name__ == "__main__":
    sys.exit(main())
