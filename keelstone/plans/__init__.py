"""Curation, reconciliation, operations and data-quality jobs."""
