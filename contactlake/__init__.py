"""contactlake: contact extraction and list hygiene as Spark DataFrame jobs."""

__version__ = "0.1.0"
