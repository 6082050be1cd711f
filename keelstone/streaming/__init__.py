"""Structured Streaming shell around landing and curation."""
