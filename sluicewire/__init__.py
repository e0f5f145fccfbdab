"""sluicewire: event analytics and correlation on PySpark DataFrames."""

__version__ = "0.1.0"
