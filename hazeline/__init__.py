"""Station-panel air-quality analytics and forecasting on PySpark."""
