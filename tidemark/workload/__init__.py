"""The registered queries: every operator run on the given tables, with reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def catalogue() -> dict[str, tuple[Query, str | None]]:
    """Name of each query with its function and, where there is one, its reference SQL."""
    from tidemark.workload import archive, links, models, panels, ranks, resumption, scalars

    out: dict[str, tuple[Query, str | None]] = {}
    for module in (scalars, links, panels, ranks, archive, resumption, models):
        clash = out.keys() & module.QUERIES.keys()
        if clash:
            raise ValueError(f"query named twice: {sorted(clash)}")
        out.update(module.QUERIES)
    return out
