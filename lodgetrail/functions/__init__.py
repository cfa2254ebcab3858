"""Column builders: scalar rules written with built-in Spark SQL functions."""
