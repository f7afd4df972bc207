"""All queries of the library (without the ``llm`` subpackage) by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import artefacts, graph, readers, relational, rollups, scores, sev, structure, text

_MODULES = (rollups, text, scores, relational, graph, sev, structure, artefacts, readers)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _m in _MODULES:
    QUERIES.update(_m.QUERIES)
    ORACLES.update(_m.ORACLES)
