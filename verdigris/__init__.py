"""Evaluation, calibration, cohort and retrieval operators on Spark DataFrames."""
