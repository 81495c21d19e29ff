"""shiftlens: Spark-native trial-adoption analytics over product-event logs."""

__version__ = "0.1.0"
