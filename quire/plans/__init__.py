"""Helpers that shape physical plans: reading tables, spreading work, staging results, shipping code."""

from quire.plans.shipping import ship
from quire.plans.staging import bounded_sample, read_table, release, shared_folder, spread, staged

__all__ = ["bounded_sample", "read_table", "release", "shared_folder", "ship", "spread", "staged"]
