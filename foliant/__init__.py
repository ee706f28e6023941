"""Foliant: a PySpark-native engine for document, retrieval and call-log processing.

Everything is declared on DataFrames / Spark SQL; Python runs only in Arrow batches where the
built-in expressions cannot state the operator.
"""
__version__ = "0.1.0"
