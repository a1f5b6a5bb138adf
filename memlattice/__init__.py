"""Repository-memory analytics as PySpark plans."""
