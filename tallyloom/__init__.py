"""Account-statement analytics on Spark: readers, one transaction model, and DataFrame operators over it."""

__version__ = "0.1.0"
