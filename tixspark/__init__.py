"""tixspark: ticket analytics, redaction and routing as Spark DataFrame jobs."""

__version__ = "0.1.0"
