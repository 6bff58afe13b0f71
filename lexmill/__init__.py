"""lexmill: a Spark-first engine for linked-document search corpora."""

__version__ = "0.1.0"
