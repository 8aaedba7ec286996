"""All registered queries; importing a family registers its queries."""

from fleetlens.plans import (  # noqa: F401
    alerts,
    backup,
    blocking,
    config,
    events,
    indexes,
    nested,
    restore,
    security,
    star,
)
from fleetlens.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
