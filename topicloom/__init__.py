"""Topic clustering of short text records on Spark."""

__version__ = "0.1.0"
