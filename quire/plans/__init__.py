"""Registered queries of the library."""

from . import boxes, chain, derived, dialogue, ledger, limits, mapped, reach, records, saved, search, strings, text, values, workspace  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
