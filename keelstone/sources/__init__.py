"""Readers of batch files, drops, snapshots, extracts and change events."""
