"""All queries outside the text subpackage."""

from __future__ import annotations

from raylattice.plans import ct, data, kernel, kernel_sql

QUERIES = {**data.QUERIES, **ct.QUERIES, **kernel.QUERIES}
ORACLES = {**data.ORACLES, **ct.ORACLES, **kernel_sql.ORACLES}
