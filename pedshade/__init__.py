"""A PySpark-native analytics engine for shade-aware pedestrian networks."""

__version__ = "0.1.0"
