"""Query-focused retrieval and evaluation over long conversations, as Spark jobs."""

__version__ = "0.1.0"
