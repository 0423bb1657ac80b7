"""A PySpark-native engine for climate and precipitation analytics.

Data are long DataFrames of (series keys, time, value); operators are functions from DataFrames to
DataFrames.
"""
