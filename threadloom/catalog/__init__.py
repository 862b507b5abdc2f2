"""Named queries over the driver's tables. Importing the package fills the registry."""

from threadloom.catalog import activity, consolidation, references, segmentation, summaries, tables  # noqa: F401
from threadloom.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
