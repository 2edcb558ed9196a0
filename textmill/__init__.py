"""textmill: a Spark-first engine that turns raw text, web pages and office files into training-ready datasets."""

__version__ = "0.1.0"
