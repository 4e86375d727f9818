"""Scalar functions: each takes and gives Columns, and runs on the JVM unless said otherwise."""
