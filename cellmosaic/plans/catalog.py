"""All registered queries. Importing the query modules fills the registry."""

from __future__ import annotations

from cellmosaic.plans import (  # noqa: F401
    annotation_queries,
    metric_queries,
    model_queries,
    registry,
    report_queries,
    spatial_queries,
)


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLES)
