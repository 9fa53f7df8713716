"""Spark-native retrieval, ranking and data-processing operators.

Operators are plain functions from DataFrames to DataFrames; column names are
parameters, so the same operator serves any table of the right shape.
"""

__version__ = "0.1.0"
