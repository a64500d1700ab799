"""foldlake: compressed archives as relational tables on PySpark."""

__version__ = "0.1.0"
