"""All queries of the engine's own operators; importing the modules registers them."""

from tessera.plans import files, graphs, metrics, more, rows, tables  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES  # noqa: F401
