"""Graphs of source code and linked data, as DataFrames."""
