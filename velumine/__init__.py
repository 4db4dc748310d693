"""velumine: hybrid search, graph and record analytics expressed as Spark plans."""

__version__ = "0.1.0"
