"""Training data for text rankers, prepared and evaluated as Spark jobs."""

__version__ = "0.1.0"
