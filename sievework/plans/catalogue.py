"""All queries of the core and the SQL of those that SQL can express."""

from __future__ import annotations

from sievework.plans import lifecycle, problems, reference, reference_sql

FLAGSHIP = "screen_applicants"
QUERIES = problems.QUERIES | reference.QUERIES | lifecycle.QUERIES
ORACLES = problems.ORACLES | reference_sql.ORACLES | lifecycle.ORACLES
