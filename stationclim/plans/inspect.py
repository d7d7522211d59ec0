"""Plan inspection helpers used by tests and for tuning (``explain`` parsing)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def physical_plan(df: DataFrame) -> str:
    """The physical plan as text (AQE's initial plan when adaptive execution is on)."""
    return df._jdf.queryExecution().executedPlan().toString()


def _nodes(df: DataFrame):
    """Physical operators of ``df`` (a cached relation's plan is not descended into)."""
    root = df._jdf.queryExecution().executedPlan()
    if root.nodeName() == "AdaptiveSparkPlan":
        root = root.executedPlan()
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        it = node.children().iterator()
        while it.hasNext():
            stack.append(it.next())


def count_exchanges(df: DataFrame) -> int:
    """Shuffle exchanges (not broadcasts) of ``df``'s own plan."""
    return sum(1 for n in _nodes(df) if n.nodeName() == "Exchange")


def uses_object_aggregate(df: DataFrame) -> bool:
    """True if an ObjectHashAggregate (e.g. collect_list) is planned."""
    return "ObjectHashAggregate" in physical_plan(df)


_SCAN_KEYS = ("DataFilters", "Format", "Location", "PartitionFilters", "PushedFilters", "ReadSchema")


def scan_nodes(df: DataFrame) -> list[dict[str, str]]:
    """Attributes of each file scan (PushedFilters, PartitionFilters, ReadSchema, DataFilters).

    Long values are truncated by Spark with ``...``; each value runs up to
    the next attribute name.
    """
    out = []
    for line in physical_plan(df).splitlines():
        if "FileScan" not in line:
            continue
        marks = sorted((m.start(), m.group(1)) for m in re.finditer(r"(?:, |\] )(" + "|".join(_SCAN_KEYS) + r"): ", line))
        node = {k: "" for k in _SCAN_KEYS}
        for i, (pos, key) in enumerate(marks):
            begin = line.index(": ", pos) + 2
            end = marks[i + 1][0] if i + 1 < len(marks) else len(line)
            node[key] = line[begin:end]
        out.append(node)
    return out
