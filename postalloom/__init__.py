"""Entity resolution for postal records, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
