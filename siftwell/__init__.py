"""siftwell: rank new data items by what they add to a corpus, on Spark DataFrames."""

__version__ = "0.1.0"
