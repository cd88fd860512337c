"""stellate: structural analytics over source-code symbol graphs, written for Spark DataFrames."""

__version__ = "0.1.0"
