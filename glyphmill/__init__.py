"""glyphmill: DataFrame operators for building, cleaning and studying text corpora on Spark."""

__version__ = "0.1.0"
