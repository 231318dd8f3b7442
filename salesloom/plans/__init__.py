"""All registered queries and their SQL twins."""

from salesloom.plans import (  # noqa: F401
    clean_queries,
    customer_queries,
    kpi_queries,
    model_queries,
    profile_queries,
    source_queries,
)
from salesloom.plans.registry import ORACLES, QUERIES, runnable  # noqa: F401
