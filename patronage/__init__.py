"""Customer analytics as Spark jobs: sources, operators and run plans."""

__version__ = "0.1.0"
