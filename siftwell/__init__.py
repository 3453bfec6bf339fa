"""siftwell: corpus building, curation and score auditing on Spark DataFrames."""

__version__ = "0.1.0"
