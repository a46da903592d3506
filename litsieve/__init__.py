"""litsieve: screening of research-paper records on Spark."""

__version__ = "0.1.0"
