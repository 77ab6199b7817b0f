"""lakekit: lake curation operators as PySpark DataFrame jobs."""

__version__ = "0.1.0"
