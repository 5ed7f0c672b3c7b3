"""The garden queries by name, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from canopia.plans import commanding, contracts, cutting, exchange, garden, grids, judgements, learning, lookups, measures, photos, reads, reviewing, shapes, sites, streams
from canopia.sources.tables import with_views

_ALL = garden.PLANS | reads.PLANS | shapes.PLANS | measures.PLANS | learning.PLANS | reviewing.PLANS | lookups.PLANS | judgements.PLANS | grids.PLANS | contracts.PLANS | photos.PLANS | sites.PLANS | cutting.PLANS | streams.PLANS | commanding.PLANS | exchange.PLANS
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for k, (f, _) in _ALL.items()}
ORACLES: dict[str, str] = {k: with_views(sql) for k, (_, sql) in _ALL.items() if sql}
