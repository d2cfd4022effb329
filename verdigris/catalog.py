"""All queries of the library's own operators with their SQL."""

from __future__ import annotations

from .plans import base, calibration, cohorts, completions, evaluation, modelling, protocols, retrieval, statistics

MODULES = (evaluation, calibration, retrieval, statistics, cohorts, modelling, protocols, completions)
QUERIES, ORACLES = base.QUERIES, base.ORACLES
