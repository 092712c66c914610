"""Paged-document analytics on Spark: documents, pages, spans and annotations as DataFrames."""

__version__ = "0.1.0"
