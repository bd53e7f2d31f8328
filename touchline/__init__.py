"""touchline: a PySpark-native match-event analytics engine."""

__version__ = "0.1.0"
