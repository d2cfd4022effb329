"""Structured Streaming forms of what grows by appending: result rows and corpora."""
