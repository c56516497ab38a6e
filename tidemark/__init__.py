"""A Spark-native engine for multi-step forecasting over many series."""
