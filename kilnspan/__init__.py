"""kilnspan: analytics over training telemetry, expressed as Spark plans."""

__version__ = "0.1.0"
