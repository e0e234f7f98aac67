"""locusflow: a PySpark-native engine for location catalogues, rankings, series and behaviour logs."""

__version__ = "0.1.0"
