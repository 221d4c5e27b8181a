"""Lowering of logical plans to DataFrames."""
