"""symloom: a PySpark engine for symbol-keyed knowledge about code bases."""

__version__ = "0.1.0"
