"""teleloom: application-telemetry analytics as plain Spark DataFrame functions.

Every operator is a function from DataFrames (plus parameters) to a DataFrame.
Nothing is collected to the driver; batch and streaming jobs share the same
transformations.
"""
