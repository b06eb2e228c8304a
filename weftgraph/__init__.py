"""Graph analytics as Spark programs: a graph is a pair of DataFrames."""

__version__ = "0.1.0"
