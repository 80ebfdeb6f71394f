"""Named queries; importing the modules fills the registry."""

from nodalis.plans import features, grading, ingest, models, names, panels, projection, runs, studies, views  # noqa: F401
from nodalis.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
