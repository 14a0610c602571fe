"""Registered queries: one callable per operator, with SQL to check it against."""

from flowtriage.plans import aggregates, composed, models, policy, projections, samples, scans, stores, streams, windows

MODULES = (scans, projections, aggregates, windows, samples, models, policy, stores, streams, composed)


def all_queries() -> dict:
    found: dict = {}
    for module in MODULES:
        found.update(module.QUERIES)
    return found


def all_oracles() -> dict:
    found: dict = {}
    for module in MODULES:
        found.update(module.ORACLES)
    return found
