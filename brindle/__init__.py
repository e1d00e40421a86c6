"""brindle: a PySpark-native analytics and data-trust engine.

Every operator is a function from DataFrames to a DataFrame (or a streaming
transform); row-level work stays on executors.
"""
