"""gramloom: approximate string matching and text analytics as Spark DataFrame plans."""

__version__ = "0.1.0"
