"""Delivery service-time analytics on Spark DataFrames."""
