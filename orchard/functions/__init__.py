"""Scalar column functions (projections, scores, keys)."""
from orchard.functions.columns import *  # noqa: F401,F403
