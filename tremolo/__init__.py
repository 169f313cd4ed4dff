"""Spark-native analytics engine for sensing time series, with training-data operators in ``tremolo.llm``."""
