"""Imports every query module, which fills the registry."""

from flowspark.plans import (  # noqa: F401
    model_queries, monitor_queries, prepare_queries, run_queries, stream_queries,
)
from flowspark.plans.registry import ORACLES, QUERIES  # noqa: F401
