"""All core queries by name, and their SQL."""

from __future__ import annotations

from weft.operators import drift, quality, weights
from weft.plans import discovery, merging, more, problems, profiles, schemas, texts  # noqa: F401  registers queries
from weft.plans.query import QUERIES, SQL  # noqa: F401

QUERIES |= {f.__name__: f for f in (drift.p2_found, drift.p2_changes, drift.p2_table, quality.p4_found, quality.p4_profile, weights.p6_found, weights.p6_weights)}
