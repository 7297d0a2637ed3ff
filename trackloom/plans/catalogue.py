"""All registered queries of the library proper, and their SQL."""

from __future__ import annotations

from trackloom.plans import curation, evaluation, geometry, masking, picking, regions, sourcing, tracks, tuning

MODULES = (tracks, evaluation, geometry, regions, tuning, curation, sourcing, masking, picking)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
