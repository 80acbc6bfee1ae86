"""Importing this module registers every query."""

from argusframe.plans import (  # noqa: F401
    activity_queries,
    box_queries,
    carving_queries,
    casework_queries,
    incident_queries,
    integrity_queries,
    search_queries,
    stream_queries,
    tracking_queries,
    trajectory_queries,
)
from argusframe.plans.registry import ORACLES, QUERIES  # noqa: F401
