"""Readers and writers of the formats that cohorts come in."""
