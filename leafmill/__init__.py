"""leafmill: a document query engine whose plans are PySpark DataFrames."""

__version__ = "0.1.0"
