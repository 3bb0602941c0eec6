"""tideline: a log, queue-overlay and lakehouse engine expressed as Spark plans."""

__version__ = "0.1.0"
