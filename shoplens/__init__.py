"""Retail analytics on Spark: orders, products and web sessions as DataFrames."""
