"""Registered queries: every operator over the benchmark tables, with its SQL check."""

from nearwell.plans.catalog import (cleaning, dialogue, evidence, geo, jobs, ledger, registry,
                                    search, sources, streams)  # noqa: F401
from nearwell.plans.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
