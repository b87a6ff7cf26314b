"""crossweave: DataFrame operators for entity-by-month panels on Spark."""

__version__ = "0.1.0"
