"""Tessera: chromatin-accessibility analytics expressed as Spark DataFrames."""

__version__ = "0.1.0"
