"""tracewell: why-provenance query templates and corpus analytics on PySpark."""

__version__ = "0.1.0"
