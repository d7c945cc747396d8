"""All queries of the engine by name, with the SQL each is checked against."""

from __future__ import annotations

from . import audits, evidence, identity, leakage, pixels, relational, trust  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "leakage_audit"
