"""All registered queries."""

from airgrid.plans import (  # noqa: F401
    aggregate_queries,
    flagship,
    function_queries,
    slicing_queries,
    grid_queries,
    source_queries,
    statistics_queries,
    table_queries,
    window_queries,
)
from airgrid.plans.registry import ORACLES, QUERIES  # noqa: F401
