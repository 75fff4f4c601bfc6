"""Strandlake: analytics on wide feature tables, expressed in Spark DataFrames."""
