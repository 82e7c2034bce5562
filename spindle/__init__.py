"""Spindle: patch-based graph analytics on Spark DataFrames."""
