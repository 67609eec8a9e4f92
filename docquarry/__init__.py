"""Document analytics on PySpark: registration, chunking, table and chart recovery, hybrid retrieval and answer routing."""

__version__ = "0.1.0"
