"""All registered queries; importing the package registers them."""

from crosstide.catalog.registry import ENTRIES, Entry
from crosstide.catalog import q_backtests, q_discovery, q_features, q_loads, q_scan, q_signals  # noqa: F401

__all__ = ["ENTRIES", "Entry"]
