"""Run named steps so that producers precede consumers.

Steps are lazy DataFrames, so the composed plan itself is the task graph: independent steps run
as independent stages of one job, and nothing is computed before a sink asks for it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame

Step = tuple[Sequence[str], Callable[..., DataFrame]]


def compose(inputs: Mapping[str, DataFrame], steps: Mapping[str, Step]) -> dict[str, DataFrame]:
    """Build every step from the tables it reads; raises ``graphlib.CycleError`` on a circular flow."""
    tables = dict(inputs)
    order = TopologicalSorter({name: [d for d in deps if d in steps] for name, (deps, _) in steps.items()})
    for name in order.static_order():
        deps, build = steps[name]
        tables[name] = build(*[tables[d] for d in deps])
    return tables
