"""keelstone: an operational data store as Spark jobs - land, curate, reconcile, query."""

__version__ = "0.1.0"
