"""Operators on DataFrames: evaluation, calibration, folds, retrieval, cohorts, graphs, statistics, models."""
