"""pageloom: evaluation of recognised documents, expressed as Spark plans."""

__version__ = "0.1.0"
