"""quire: a Spark-first document analytics engine."""

__version__ = "0.1.0"
