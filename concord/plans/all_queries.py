"""Importing this module fills the register."""

from concord.plans import run_queries, table_queries, vector_queries, vote_queries  # noqa: F401
from concord.plans.registry import ORACLES, QUERIES  # noqa: F401
