"""bundlescan — security-indicator scanning of file/document tables as Spark jobs."""

__version__ = "0.1.0"
