"""Spark-first analytics over sequence spectra, vectors and training text."""

__version__ = "0.1.0"
