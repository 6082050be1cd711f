"""Queries over the test tables, bound to the library's entities by stand-ins, and their SQL oracles."""

from __future__ import annotations

from . import curation, files, joins, ops, quality, reads, streams

_PARTS = (reads, files, joins, curation, ops, quality, streams)


def queries():
    return {k: f for p in _PARTS for k, f in p.QUERIES.items()}


def oracles():
    return {k: s for p in _PARTS for k, s in p.SQL.items()}
