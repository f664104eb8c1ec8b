"""framespark: keyed, time-ordered signals and frames as Spark DataFrames."""

__version__ = "0.1.0"
