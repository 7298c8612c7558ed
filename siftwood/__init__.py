"""Set-oriented retrieval and corpus analytics as PySpark DataFrame pipelines."""

__version__ = "0.2.0"
