"""All registered queries."""

from wakeline.plans import (  # noqa: F401
    evaluation_queries,
    model_queries,
    profile_queries,
    proximity_queries,
    source_queries,
    stream_queries,
    track_queries,
)
from wakeline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
