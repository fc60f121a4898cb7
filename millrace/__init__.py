"""Spark-native analytics on numeric tables, matrices and time series.

Tables are DataFrames in one of three shapes: wide (a row id and DOUBLE columns), cells
(i, j, v) and row vectors (a row id and ARRAY<DOUBLE>). NaN is data in DOUBLE columns and
follows IEEE rules; NULL stands for what is missing in other types.
"""
