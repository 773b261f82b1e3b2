"""Imports every query module, so that the registry is complete."""
from mooring.plans import (  # noqa: F401
    matching, ranks, reports, scalars, storage, streams, stress,
)
from mooring.plans.registry import ORACLE, QUERIES  # noqa: F401
