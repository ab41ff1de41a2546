"""All registered queries; importing the package fills the registry."""

from canlake.plans.catalog import encodings, frames, models, scoring, sources, traffic, windows
from canlake.plans.catalog.registry import QUERIES, TWINS

__all__ = ["QUERIES", "TWINS", "encodings", "frames", "models", "scoring", "sources", "traffic", "windows"]
