"""Queries that apply the operators to the driver's tables, each with SQL for comparison where SQL can express it."""
