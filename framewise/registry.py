"""Every registered query with its twin in SQL."""

from framewise.plans import analytics, cuts, evaluation, frames, layout, ledger, pictures, rasters, streams, text, timeline

PLANS = (cuts, timeline, layout, ledger, analytics, text, streams, frames, pictures, evaluation, rasters)
QUERIES: dict = {}
ORACLES: dict = {}
for _plan in PLANS:
    QUERIES |= _plan.QUERIES
    ORACLES |= _plan.ORACLES
