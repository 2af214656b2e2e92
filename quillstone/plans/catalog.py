"""All queries of the engine and their SQL."""

from quillstone.plans import cycle, graphs, kinds, ledger, recall, records  # noqa: F401  they register their queries
from quillstone.plans.registry import ORACLES, QUERIES  # noqa: F401
